"""Personal data, with information-theoretic sanitisation of what gives it away.

Four base patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers. The protected entities are the values found and what they belong to: the domain
of an address, the network of an IP address, the issuer of a card, the area of a
phone number. How strongly a term t reveals an entity e is measured over the whole
corpus by pointwise mutual information:

    PMI(e; t) = log2( n(e,t) * N / (n(e) * n(t)) )       information content IC(e) = log2( N / n(e) )

where all counts are numbers of distinct texts that hold e, t or both anywhere, so copies of
a text are one witness on both sides. PMI(e; t) = IC(e) means that t never occurs
without e. A term is disclosive if for some entity with IC(e) >= MIN_INFORMATION bits
PMI >= ALPHA * IC(e), seen together in at least MIN_SUPPORT texts. Every occurrence of a
disclosive term in any text is reported as a span of kind ``term`` (but for words that are
part of an entity); ``sanitize`` removes these spans, or generalises them to the
term's first letter, beside masking the entities themselves.

How it is counted, without gathering anything:

* Distinct texts. Texts are counted by their 128-bit hashes. Texts that occur once are read where they
  stand; those whose bit is set in a bitmap of the repeated hashes (16 MiB, chance hits do no harm)
  pass a shuffle that leaves one of each.
* Pairs. Entities that occur in the same texts have the same figures, so they are one class. As
  n(e,t) <= n(e), only terms with n(t) <= n(e)^ALPHA * N^(1-ALPHA) can reach the threshold: the
  terms of a text are joined with their counts first, and only the rare ones meet its entity classes.
* Occurrences. A bitmap of the disclosive terms finds the words that may be one; an exact join decides.

Defined results: a null or empty text has no spans; repeated rows give repeated
results, and rows without id or with the same id are treated like any other; an empty table gives
an empty one; texts are scanned whole in time linear in their length; other columns are ignored
(``sanitize`` returns them as they are).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as sp
from .common import as_texts, bitmap, marked, materialize, renamed

KINDS = ("email", "ip", "card", "phone", "term")
ALPHA, MIN_SUPPORT, MIN_INFORMATION = 0.9, 3, 4.0
#: Distinct words that a task counts, or remembers, before it begins anew; bounds its memory, not the result.
FLUSH = 400_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TERM_EDGE = ".,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(digits: str) -> bool:
    value = digits.lstrip("0") or "0"
    return len(value) <= 3 and int(value) <= 255


def _emails(text: str) -> Iterator[sp.Span]:
    """Every address starts at the run of local characters before its @; the run is looked up
    leftwards and ends at the last address, so no run is read twice."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > done and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            yield "email", at, m.end()
            done = m.end()


def base_spans(text: str) -> list[sp.Span]:
    """The four base kinds, each leftmost and without overlaps; failing matches are dropped, not retried."""
    found = list(_emails(text)) if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_octet(x) for x in m[0].split("."))]
    if _LONG_DIGITS.search(text):
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def entities(kind: str, value: str) -> tuple[str, str]:
    """The names by which mentions of one entity meet: of the value, and of what it belongs to."""
    if kind == "email":
        value = value.lower()
        return f"email:{value}", f"domain:{value.rpartition('@')[2]}"
    if kind == "ip":
        parts = [str(int(x)) for x in value.split(".")]
        return f"ip:{'.'.join(parts)}", f"network:{'.'.join(parts[:3])}"
    digits = _NOT_DIGIT.sub("", value)
    return f"{kind}:{digits}", f"issuer:{digits[:6]}" if kind == "card" else f"area:{digits[:5]}"


def term_of(word: str) -> str:
    """The term of a word: lower-cased, without punctuation at its edges; '' for one without a letter."""
    core = word.lower().strip(_TERM_EDGE)
    return core if any(c.isalpha() for c in core) else ""


def occurrences(text: str, base: list[sp.Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every word that has a term and no part in a span."""
    ordered, k, reach = sorted((a, b) for _, a, b in base), 0, 0
    for m in _WORD.finditer(text):
        while k < len(ordered) and ordered[k][0] < m.end():
            reach = max(reach, ordered[k][1])
            k += 1
        if m.start() >= reach and (term := term_of(m[0])):
            yield term, m.start(), m.end()


def _witnesses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_texts(batch.column(2))):
            if base := base_spans(text):
                names = {x for k, s, e in base for x in entities(k, text[s:e])}
                rows.append((a, b, sorted(names), sorted({x[0] for x in occurrences(text, base)})))
        types = pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, types)], ["a", "b", "entities", "terms"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial text counts of every term."""
    counts: Counter[bytes] = Counter()
    edge = _TERM_EDGE.encode()

    def flush():
        terms = pa.array(list(counts), pa.binary()).cast(pa.string())
        batch = pa.RecordBatch.from_arrays([terms, pa.array(list(counts.values()), pa.int64())], ["term", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for text in as_texts(batch.column(0)):
            counts.update({w.strip(edge) for w in text.lower().encode().split()})
            if len(counts) > FLUSH:
                yield flush()
    if counts:
        yield flush()


def hashed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, text): every text with the two halves of its hash; null is the empty text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b"), text.alias("text"))


def distinct_texts(texts: DataFrame) -> tuple[DataFrame, int]:
    """One of each text of ``texts`` (what ``hashed`` gives), and how many they are."""
    groups = texts.groupBy("a", "b").agg((F.count("*") > 1).alias("again")).select(F.when(F.col("again"), F.col("a")).alias("key"))
    table, total = bitmap(groups, "key")
    if not table.any():
        return texts, total
    maybe_again = marked(texts.sparkSession, table)
    again = texts.where(maybe_again(F.col("a"))).dropDuplicates(["a", "b"])
    return texts.where(~maybe_again(F.col("a"))).union(again), total


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n): how many of ``texts`` (text) hold each term."""
    return texts.select("text").mapInArrow(_counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def revealing(docs: DataFrame, text_col: str = "text", alpha: float = ALPHA, min_support: int = MIN_SUPPORT, min_information: float = MIN_INFORMATION) -> tuple[DataFrame, DataFrame]:
    """(class, term, pmi, ic) of the terms that reveal the entities of a class, and (entity, class)."""
    texts = hashed(docs, text_col)
    seen = materialize(texts.mapInArrow(_witnesses, "a long, b long, entities array<string>, terms array<string>").dropDuplicates(["a", "b"]), "pii-witnesses")
    # Entities of the same texts are one class.
    held = seen.select("a", "b", F.explode("entities").alias("entity"))
    figures = held.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("a", "b")).alias("mark")).where(F.col("n_entity") >= min_support)
    unique, total = distinct_texts(texts)
    n_docs = F.lit(float(max(1, total)))
    ic = F.log2(n_docs / F.col("n_entity"))
    figures = figures.where((ic >= min_information) & (ic > 0)).withColumn("class", F.xxhash64("n_entity", "mark"))
    figures = materialize(figures, "pii-entities")
    bound = F.pow(F.col("n_entity").cast("double"), F.lit(alpha)) * F.pow(n_docs, F.lit(1 - alpha)) * (1 + 1e-9)
    of_text = held.join(figures, "entity").select("a", "b", "class", "n_entity", bound.alias("bound")).distinct()
    most = of_text.groupBy("a", "b").agg(F.max("bound").alias("most"))
    terms = seen.join(most, ["a", "b"]).select("a", "b", "most", F.explode("terms").alias("term"))
    counts = term_counts(unique).where(F.col("n") >= min_support)
    rare = terms.join(counts, "term").where(F.col("n") <= F.col("most")).select("a", "b", "term", "n")
    both = of_text.join(rare, ["a", "b"]).where(F.col("n") <= F.col("bound")).groupBy("class", "n_entity", "term", "n").agg(F.count("*").alias("n_both"))
    pmi = F.log2(F.col("n_both") * n_docs / (F.col("n_entity") * F.greatest("n", "n_both")))
    found = both.where(F.col("n_both") >= min_support).select("class", "term", pmi.alias("pmi"), ic.alias("ic")).where(F.col("pmi") >= alpha * F.col("ic") - 1e-9)
    return found, figures.select("entity", "class")


def disclosive_terms(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """(entity, term, pmi, ic) of the terms that reveal an entity."""
    found, classes = revealing(docs, text_col, **limits)
    return classes.join(found, "class").select("entity", "term", "pmi", "ic")


def _scanned(terms):
    place = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = terms.value if terms else None
        marked: dict[bytes, bool] = {}
        edge = _TERM_EDGE.encode()

        def may_reveal(term: bytes) -> bool:
            known = marked.get(term)
            if known is None:
                if len(marked) >= FLUSH:
                    marked.clear()
                bit = xxhash.xxh64_intdigest(term, 42) % (len(table) * 8)
                known = marked[term] = bool(table[bit >> 3] >> (bit & 7) & 1)
            return known

        for batch in batches:
            counts, digests, spans, places = [], [], [], []
            for text in as_texts(batch.column(1)):
                base = base_spans(text)
                counts.append([sum(s[0] == k for s in base) for k in KINDS[:4]])
                digests.append(sp.digest(base, KINDS))
                spans.append(sp.joined(base, KINDS))
                some = table is not None and any(map(may_reveal, {w.strip(edge) for w in text.lower().encode().split()}))
                places.append([{"term": t, "start": a, "end": b} for t, a, b in occurrences(text, base) if may_reveal(t.encode())] if some else [])
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            columns += [pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(places, pa.list_(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *_FOUND])

    return scan


_FOUND = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "places")
_FOUND_TYPES = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, places array<struct<term:string,start:long,end:long>>"


def _found(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], **limits) -> DataFrame:
    """Per row of ``docs``: doc_id, the columns to carry as c0, c1, ..., and what is found in the text."""
    spark = docs.sparkSession
    terms = materialize(revealing(docs, text_col, **limits)[0].select("term").distinct(), "pii-terms")
    table, n_terms = bitmap(terms.select(F.xxhash64("term").alias("key")), "key")
    others = [docs[c].alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *others)
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    scanned = rows.mapInArrow(_scanned(spark.sparkContext.broadcast(table) if n_terms else None), f"{schema}, {_FOUND_TYPES}").drop("text")
    if not n_terms:
        return scanned.drop("places")
    scanned = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "pii")
    places = scanned.select("row", F.explode("places").alias("m")).select("row", "m.*")
    extra = (
        places.join(terms, "term", "left_semi")
        .select("row", F.concat_ws(":", F.lit("term"), "start", "end").alias("span"))
        .groupBy("row")
        .agg(F.array_join(F.sort_array(F.collect_set("span")), ",").alias("term_spans"))
    )

    @F.pandas_udf("string")
    def merged(base, more):
        import pandas as pd

        return pd.Series([sp.joined(set(sp.parse(b)) | set(sp.parse(m)), KINDS) for b, m in zip(base, more)], dtype=object)

    spans = F.when(F.col("term_spans").isNull(), F.col("spans")).otherwise(merged("spans", "term_spans"))
    return scanned.drop("places").join(extra, "row", "left").withColumn("spans", spans).drop("row", "term_spans")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Base counts and digest, and all spans with those of disclosive terms, per row of ``docs``."""
    return _found(docs, id_col, text_col, (), **limits).select("doc_id", *_FOUND[:-1])


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: bool = False, **limits) -> DataFrame:
    """``docs`` with every entity masked by its kind, and disclosive terms removed or, with
    ``generalise``, cut to their first letter and a dot. Null texts stay null. Texts stay beside their
    spans all the way, so ids may be null or repeated."""

    @F.pandas_udf("string")
    def clean(texts, found):
        import pandas as pd

        def mask(kind, value):
            return (value[:1] + "." if generalise else "") if kind == "term" else f"[{kind.upper()}]"

        return pd.Series([x if x is None else sp.replace(x, sp.parse(s), mask) for x, s in zip(texts, found)], dtype=object)

    rows = _found(docs, id_col, text_col, tuple(docs.columns), **limits)
    return rows.select(*[(clean(f"c{i}", "spans") if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
