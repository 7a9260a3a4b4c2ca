import random

import numpy as np
import pyarrow as pa

from falloff.llm import ngram_join as nj


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute_sets(rows):
    out = []
    for _, text in rows:
        w = words_of(text)
        out.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return out


def brute(rows, percent=75):
    sets = brute_sets(rows)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (id, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), id), id)
    return sorted((id, len(sets[i]), low[find(i)]) for i, (id, _) in enumerate(rows))


def fixture(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = say(60)
    rows = []
    for _ in range(60):  # many documents share a passage
        rows.append(say(r.randrange(5, 120)) + passage + say(r.randrange(0, 60)))
    for _ in range(8):  # groups of near copies, some at the threshold
        base = say(r.randrange(20, 300))
        for _ in range(r.randrange(2, 25)):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 18))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(copy)
    rows += [say(3)] * 3 + [say(1)] + [say(4)] * 2
    texts = [" ".join(w) for w in rows]
    texts += [None, "", "  \t\n", None, texts[0].upper(), texts[1].replace(" ", "\n\t "), " ".join(say(30_000))]
    texts.append(texts[-1] + " one more word here")
    ids = list(range(1, len(texts) + 1))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def test_whole_sets_of_batches_equal_those_of_single_texts():
    texts = ["a b c d e f", "", None, "A  b\tC d E f", "x", "x y", "é ü ö ä ß q", "a b c d e f " * 200_000, "tail of five words here"]
    got = dict(nj.shingle_sets(pa.array(texts, type=pa.string())))
    assert sorted(got) == [0, 3, 4, 5, 6, 7, 8]
    assert (got[0] == got[3]).all() and len(got[0]) == 2 and len(got[7]) == 6
    for k, s in got.items():
        assert (s == nj.shingles(texts[k])).all()
    sliced = dict(nj.shingle_sets(pa.array(texts, type=pa.string()).slice(3, 4)))
    assert (sliced[0] == got[3]).all() and sorted(sliced) == [0, 1, 2, 3]
    only = dict(nj.shingle_sets(pa.array(texts, type=pa.string()), rows=np.array([4, 8])))
    assert sorted(only) == [4, 8] and (only[8] == got[8]).all()


def test_a_word_longer_than_a_slice():
    long = "z" * 5_000_000
    a, b = nj.shingles(f"one two {long} three four five six"), nj.shingles(f"one two {long} three four five seven")
    assert len(a) == 3 and len(np.intersect1d(a, b)) == 2
    assert len(nj.shingles("k " * 3_000_000)) == 1


def test_links_as_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in nj.link_classes(docs).collect())
    assert got == brute(rows)


def test_components_with_high_threshold_and_extra_columns(spark):
    rows = fixture(2)[:80]
    docs = spark.createDataFrame([(a, b, 1, None) for a, b in rows], "doc_id long, text string, n long, class string")
    assert sorted(tuple(r) for r in nj.link_classes(docs, percent=90).collect()) == brute(rows, 90)
    kept = nj.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute(rows) if i == c)


def test_empty_repeated_and_null_ids(spark):
    assert nj.link_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None), (None, None)]
    got = nj.link_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == [("1", 3, "1"), ("1", 3, "1"), ("2", 0, "2"), ("None", 0, "None"), ("None", 3, "1")]


def test_prefix_lemma_holds_for_lengths_chosen_by_either_side():
    for percent in (75, 90):
        for n in range(1, 400):
            for m in range(max(1, nj._needed(n, percent)), 100 * n // percent + 1):
                overlap = -(-percent * (n + m) // (100 + percent))
                for lx, ly in zip(nj._lengths(n), nj._lengths(m), strict=True):
                    # What pairs of these sizes need of the other's prefix lies in its longest one.
                    assert lx <= overlap and m - overlap + lx <= m - nj._needed(m, percent) + nj._lengths(m)[-1]


def test_chains_of_near_copies_are_joined_over_rounds(spark):
    r = random.Random(11)
    text, rows = [f"w{r.randrange(10_000)}" for _ in range(120)], []
    for k in range(150):  # each copy changes a little of the one before
        text = list(text)
        text[r.randrange(len(text))] = f"w{r.randrange(10_000)}"
        rows.append((1000 - k, " ".join(text)))
    got = sorted(tuple(x) for x in nj.link_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
