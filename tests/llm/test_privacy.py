import hashlib
import random
import re

import numpy as np
import pandas as pd

from falloff.llm import privacy

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            s = m.group()
            digits = re.sub("[^0-9]", "", s)
            good = {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_as_the_plain_patterns():
    r = random.Random(1)
    samples = ["a@b.c", "x..y@@d-e.f.g", "a@b@c.de", "@x.y", "me@host", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+123", "+12345678901234567", "ü me@x.org", "", None, "a@b.c.d@e.f", "1.2.3.4@x.y"]
    alphabet = "a1.@-+ 4()é 5"
    samples += ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(3000)]
    samples += ["".join(r.choice("0123456789 -.") for _ in range(40)) for _ in range(1500)]
    for text in samples:
        assert privacy.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "a.b" * 100_000 + "@", "1.1" * 100_000, "+1 " * 100_000, "a@" * 150_000, "- 1" * 100_000):
        privacy.base_spans(text)


def brute_terms(rows, reveal=0.9, support=3):
    import math

    docs = []
    for id, text in rows:
        spans = plain(text)
        entities = set()
        for k, a, b in spans:
            v = text[a:b]
            entities.add((k, v.lower() if k in ("email", "ip") else re.sub("[^0-9]", "", v)))
        terms = [(m.group().lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{4,}", text or "") if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        every = {m.group().lower() for m in re.finditer(r"[^\W\d_]{4,}", text or "")}
        docs.append((id, text, spans, entities, terms, every))
    total, tells = len(docs), set()
    entities = {e for d in docs for e in d[3]}
    for e in entities:
        of = [d for d in docs if e in d[3]]
        if len({d[1] for d in of}) < support or len(of) == total:
            continue
        for t in {x[0] for d in of for x in d[4]}:
            both = [d for d in of if t in {x[0] for x in d[4]}]
            if len({d[1] for d in both}) < support:
                continue
            n_t = sum(t in d[5] for d in docs)
            pmi = math.log2(len(both) * total / (len(of) * n_t))
            if pmi >= reveal * math.log2(total / len(of)):
                tells.add((e, t))
    out = []
    for id, _, spans, held, terms, _ in docs:
        added = sorted({(a, b) for t, a, b in terms if any((e, t) in tells for e in held)})
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        every = ",".join([*([base] if base else []), *(f"term:{a}:{b}" for a, b in added)])
        out.append((id, hashlib.sha256(base.encode()).hexdigest(), every, len(added)))
    return sorted(out, key=str)


def fixture():
    r = random.Random(2)
    words = ["steady", "market", "garden", "über", "common", "report", "window"]
    rows = []
    for k in range(120):
        text = " ".join(r.choice(words) for _ in range(12))
        if k % 10 == 0:
            text += f" Ask Zephyrine of Quillon at zeph@x.org {k}"
        elif k % 10 == 1:
            text += f" call +1 555 010 {1000 + k} or steady market"
        elif k % 10 == 2:
            text += f" from 10.0.0.7 node{k} Bracken window"
        rows.append((k, text))
    return [*rows, (500, None), (501, ""), (502, "zeph@x.org Zephyrine"), (502, "zeph@x.org Zephyrine"), (503, "Zephyrine alone")]


def test_terms_as_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(a, b, "x", 3) for a, b in rows], "doc_id long, text string, spans string, page int")
    found = privacy.detect(docs)
    got = sorted(((x["doc_id"], x["base_sha256"], x["spans"], x["n_term"]) for x in found.collect()), key=str)
    assert got == brute_terms(rows)
    assert any(n for *_, n in got)
    assert privacy.detect(docs.limit(0)).count() == 0


def test_sanitised_texts_hold_neither_data_nor_telling_terms(spark):
    rows = [x for k, x in enumerate(fixture()) if k != 123]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in privacy.sanitise(docs, privacy.detect(docs)).collect()}
    assert len(out) == len(rows) and out[500] is None and out[501] == ""
    assert "zeph@" not in out[0] and "Zephyrine" not in out[0] and "[email]" in out[0] and "[term]" in out[0]
    assert out[503] == "Zephyrine alone"
    assert privacy.generalise("ab cd ef", "email:0:5,ip:3:8") == "[email]"


def test_entities_of_one_or_two_texts_have_telling_terms(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in f"{k:04d}") + "son"
    rows = [(k, f"steady market report window, asks {name(k)} at {name(k)[:4]}@x.org") for k in range(60)]
    rows += [(100 + k, f"garden {name(k)} again {name(k)[:4]}@x.org") for k in range(20)] + [(200 + k, "steady market garden") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x["text"] for x in privacy.sanitise(docs, privacy.detect(docs)).collect()}
    assert all(out[k] == "steady market report window, asks [term] at [email]" for k in range(60))
    assert all(out[100 + k] == "garden [term] again [email]" for k in range(20)) and out[200] == "steady market garden"


def test_many_entities_and_terms_in_one_text_come_in_pieces(monkeypatch):
    text = " ".join(f"user{i}@mail{i}.example word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    frame = lambda: iter([pd.DataFrame({"id": [1], "text": [text]})])
    told = np.ones(privacy._BITS, dtype=bool)
    whole = pd.concat(privacy._pairs(frame())), pd.concat(privacy._places(frame(), told))
    monkeypatch.setattr(privacy, "_AT_ONCE", 1000)
    pieces = list(privacy._pairs(frame())), list(privacy._places(frame(), told))
    for one, some in zip(whole, pieces, strict=True):
        assert len(some) >= 50 and max(map(len, some)) <= 2000
        columns = [c for c in ("id", "e", "t", "a", "b") if c in one]
        assert sorted(map(tuple, one[columns].to_numpy().tolist())) == sorted(map(tuple, pd.concat(some)[columns].to_numpy().tolist()))
    assert len(whole[0]) == 300 * len(set(whole[0]["t"])) and set(whole[0]["e"]) == set(whole[1]["e"])
