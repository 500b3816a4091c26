"""Groups, links and counts of two tokenizers against whole texts encoded one by one."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import pyarrow.parquet as pq
import pytest
from merchloom.llm import alignment
from merchloom.llm.alignment import FILE_A, FILE_B

PARTS = [" ", "  ", "\n", "\r", "\r\n", "\t", "\x1c", "\x85", " ", " ", "　", "​", "▁", "\x00", "a", "word", "Word", "été", "œuvre", "'s", "'ll", "don't", "中文", "😀", "é", "123", "4 5", "...", "_-_", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "(x){\r", "http://a.b/c?d=e&f", "…"]


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILE_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILE_B)


def tokens(encoders, text):
    """(A ids with bytes, B ids with bytes) of a whole text; None if it has no tokens."""
    a, b = encoders
    if not text:
        return None
    alphabet = alignment.byte_alphabet()
    ours = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    theirs = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        theirs.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (ours, theirs) if b"".join(x for _, x in ours) == whole == b"".join(x for _, x in theirs) else None


def ends(side):
    at = 0
    for i, x in side:
        at += len(x)
        yield at, i


def groups_of(a, b):
    """(places where tokens of both end, groups) of two lists of (end, id)."""
    common = sorted({e for e, _ in a} & {e for e, _ in b})
    groups = [([], []) for _ in common]
    for side, ends_ in enumerate((a, b)):
        for e, i in ends_:
            groups[bisect_left(common, e)][side].append(i)
    return common, groups


def plain(encoders, texts):
    """The whole report, by sets of ends and a counter of links."""
    cut = []
    for text in texts:
        found = tokens(encoders, text)
        if found is None:
            cut.append(None)
            continue
        a, b = list(ends(found[0])), list(ends(found[1]))
        common, groups = groups_of(a, b)
        at_a, at_b = {}, {}
        for at, side in ((at_a, a), (at_b, b)):
            for e, i in side:
                at.setdefault(e, []).append(i)
        links = [(i, j) for e in common for i in at_a[e] for j in at_b[e]]
        cut.append((len(a), len(b), groups, links))
    count = Counter(link for c in cut if c for link in c[3])
    highest = Counter()
    for (_, j), n in count.items():
        highest[j] = max(highest[j], n)
    out = []
    for c in cut:
        if c is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in c[2]).encode()).hexdigest()
        out.append((c[0], c[1], len(c[2]), len(c[3]), sum(count[k] == highest[k[1]] for k in c[3]), sum(count[k] for k in c[3]), digest))
    return out


def awkward(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_pieces_are_encoded_as_in_their_text(encoders):
    """Pieces give the tokens of whole texts, for awkward ones and for those of the smallest table."""
    pair = alignment.pair_of(FILE_A, FILE_B)
    assert pair.apart
    texts = awkward(3000, 1) + [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]
    for text in texts:
        pieces = alignment._PIECES.findall(" " + text)
        assert "".join(pieces) == " " + text
        if "▁" in text:
            assert tokens(encoders, text) is None
            continue
        a, n_a, b, n_b = pair.encode(pieces)
        want = tokens(encoders, text)
        if want is None:
            assert not (n_a > 0).all()
        else:
            assert (a.tolist(), b.tolist()) == ([i for i, _ in want[0]], [i for i, _ in want[1]])


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("size", [alignment.CHUNK, 500])
def test_report(spark, encoders, docs, rows, size):
    """Every size of chunk gives the result of plain counting; ids may be null or repeated."""
    rows = [*rows, *((5000 + i, t, *rows[0][2:]) for i, t in enumerate(awkward(60, 2))), (None, "no id here", *rows[0][2:])]
    found = alignment.align(spark.createDataFrame(rows, docs.schema).repartition(3), size=size)
    want = [(r[0], *p) for r, p in zip(rows, plain(encoders, [r[1] for r in rows]))]
    assert sorted(map(repr, map(tuple, found.select("doc_id", *COLUMNS).collect()))) == sorted(map(repr, want))


def test_lexicon_by_texts(spark, encoders, docs, rows):
    """The other weight: in how many texts a group stands."""
    texts = [tokens(encoders, r[1]) for r in rows]
    count = Counter()
    for t in texts:
        if t:
            a, b = list(ends(t[0])), list(ends(t[1]))
            count.update((x[-1], y[-1]) for x, y in {(tuple(x), tuple(y)) for x, y in groups_of(a, b)[1]})
    found = {(r.a, r.b): r["count"] for r in alignment.lexicon(docs, weigh="docs", size=700).collect()}
    assert found == count


def test_empty(empty):
    assert alignment.align(empty).collect() == [] and alignment.lexicon(empty).collect() == []


def test_vocabularies_that_do_not_fit_into_two_bytes():
    """Groups with large ids or many ids take the general way."""
    import numpy as np

    a, b = np.array([70000, 5, 6, 7, 8, 9, 70000]), np.array([1, 2, 3, 4])
    group, keys = alignment._interned(a, b, np.array([0, 1, 3, 6, 7]), np.array([0, 1, 2, 3, 4]))
    shown = [np.frombuffer(keys[g], ">u4").tolist() for g in group]
    assert shown == [[1, 70000, 1], [2, 5, 6, 2], [3, 7, 8, 9, 3], [1, 70000, 4]]
