"""Readers and writers: tolerant CSV, binary gauge files, dBase, workbooks, listings."""
