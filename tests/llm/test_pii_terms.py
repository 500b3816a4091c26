"""Disclosive terms against a brute-force computation over distinct texts, and sanitising row by row."""

import math
import random
from collections import defaultdict

import pytest

from merchloom.llm import common, pii
from merchloom.llm import spans as sp

SCHEMA = "doc_id long, text string"


def corpus(copies=1):
    """Five reports that name a person far from the address, among rows of other words."""
    rng = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts = []
    for i in range(5):
        filler = " ".join(rng.choices(words, k=60))
        texts += [f"Falkenried, {filler} unit{i} write to Eva@mail.example.org now"] * copies
    texts += ["Falkenried was seen here today"] + [" ".join(rng.choices(words, k=40)) for _ in range(300)]
    texts += [f"{' '.join(rng.choices(words, k=9))} x{i}@mail.example.org" for i in range(4)]
    return texts


def brute(texts, alpha=pii.ALPHA, support=pii.MIN_SUPPORT, bits=pii.MIN_INFORMATION):
    of_entity, of_term, near = defaultdict(set), defaultdict(set), defaultdict(set)
    distinct = sorted({t or "" for t in texts})
    for i, text in enumerate(distinct):
        base = pii.base_spans(text)
        names = {x for k, a, b in base for x in pii.entities(k, text[a:b])}
        for word in text.split():
            of_term[word.lower().strip(".,;:!?\"'()[]{}<>|*#$%&")].add(i)
        own = {t for t, _, _ in pii.occurrences(text, base)}
        for e in names:
            of_entity[e].add(i)
            for t in own:
                near[e, t].add(i)
    found = {}
    for (e, t), docs in near.items():
        n, ic = len(distinct), math.log2(len(distinct) / len(of_entity[e]))
        value = math.log2(len(docs) * n / (len(of_entity[e]) * len(of_term[t])))
        if len(docs) >= support and ic >= bits and value >= alpha * ic - 1e-9:
            found[e, t] = round(value, 9), round(ic, 9)
    return found


@pytest.mark.parametrize("copies", [1, 100])
def test_terms_match_brute_force(spark, copies):
    texts = [*corpus(copies), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = {(r["entity"], r["term"]): (round(r["pmi"], 9), round(r["ic"], 9)) for r in pii.disclosive_terms(docs).collect()}
    want = brute(texts)
    assert got == want and ("email:eva@mail.example.org", "falkenried") in want
    terms = {t for _, t in want}
    for r in pii.detect(docs).collect():
        text = texts[r["doc_id"]] or ""
        base = pii.base_spans(text)
        assert sp.parse(r["spans"]) == sp.parse(sp.joined([*base, *[("term", a, b) for t, a, b in pii.occurrences(text, base) if t in terms]], pii.KINDS))
    assert any("term" in r["spans"] and not r["n_email"] for r in pii.detect(docs).collect())  # without the address, too


def test_sanitize_goes_by_row(spark):
    texts = corpus()
    rows = [(None if i % 2 else 1, t) for i, t in enumerate(texts)] + [(1, "mail bob@site.example.com now"), (1, "call +1 (212) 555-0199 w"), (None, "mail eve@site.example.com now"), (1, None)]
    terms = {t for _, t in brute([t for _, t in rows])}

    def clean(text, cut):
        if text is None:
            return None
        base = pii.base_spans(text)
        spans = [*base, *[("term", a, b) for t, a, b in pii.occurrences(text, base) if t in terms]]
        return sp.replace(text, spans, lambda kind, x: (x[:1] + "." if cut else "") if kind == "term" else f"[{kind.upper()}]")

    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for cut in (False, True):
        got = [(r["doc_id"], r["text"]) for r in pii.sanitize(docs, generalise=cut).collect()]
        key = lambda r: (r[0] is None, r[1] or "")
        assert sorted(got, key=key) == sorted([(d, clean(t, cut)) for d, t in rows], key=key)
    assert "Falkenried" not in "".join(t or "" for _, t in got) and "F." in "".join(t or "" for _, t in got)


def test_many_entities_in_few_texts_are_one_class(spark):
    lists = " ".join(f"u{i}@list.example.org" for i in range(300))
    texts = [f"{lists} {x} rollcall" for x in ("one", "two", "three")] + [f"other text {i}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    found, classes = pii.revealing(docs)
    assert [(r["term"]) for r in found.collect()] == ["rollcall"] and classes.count() == 301


def test_bitmap_holds_every_key(spark):
    keys = [5, -5, 0, 2**62, -(2**63), 2**63 - 1, None]
    table, n = common.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"), "key", 1 << 16)
    import numpy as np

    assert n == len(keys) and common.has_bit(table, np.array(keys[:-1], np.int64)).all()
    assert np.unpackbits(table).sum() == len({k % 65536 for k in keys[:-1]})
    assert not common.has_bit(table, np.array([7], np.int64))[0]


def test_materialize_on_a_cluster_wants_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_materialize_removes_what_it_replaces(spark):
    import os

    first = common.materialize(spark.range(5).toDF("a"), "probe")
    folder = os.path.dirname(first.inputFiles()[0].removeprefix("file:"))
    second = common.materialize(first.selectExpr("a + 1 AS a"), "probe", replaces=first)
    assert not os.path.exists(folder) and sorted(r["a"] for r in second.collect()) == [1, 2, 3, 4, 5]
    assert common.materialize(spark.range(0).toDF("a"), "probe").count() == 0


def test_a_table_of_which_rows_cannot_be_seen_is_an_error(spark, monkeypatch):
    class Other(common.Observation):
        get = property(lambda self: {"n": 6})

    monkeypatch.setattr(common, "Observation", Other)
    with pytest.raises(RuntimeError, match="not shared"):
        common.materialize(spark.range(5).toDF("a"), "probe")
