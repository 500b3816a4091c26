"""Secret scans by assignment-aware lexing.

Three base patterns find assignments to sensitive words, access key ids and long
hexadecimal runs. Beside them a lexer reads source code and configuration into tokens in one
pass (strings with escapes, triple-quoted and escaped strings, names, operators, line ends), and
the tokens into name-literal pairs:

    name = literal    name: literal    "name": "literal"    name => literal    obj["name"] = "literal"
    name: Type = "literal"    f(name="literal")    setName("literal")    put("name", "literal")
    <name>literal</name>    <add key="name" value="literal"/>    export NAME=literal    name: | and a block of lines
    <property name="name"><value>literal</value>    name: and a list of lines "- literal"    [a, b] = ["literal", "literal"]

A string may stand on a line after its operator. A literal may be several strings, adjacent or joined by ``+`` or ``.``; comments may stand between, and a call around
it is looked through. A bare name on the right is a reference, and its constant value is propagated over
any number of steps: ``K = "..."`` before or after ``password = K`` makes the literal of ``K`` a password.
Environment references (``$NAME``, ``os.environ``) and names without a digit are never literals. The contents of
strings are read in the same way, once. A literal is scored by how sensitive its target names are, as words
(``author`` isn't ``auth``, and ``token_count`` counts tokens), and by its own shape (length, entropy, mix of characters, not a placeholder);
scores of at least ``MIN_SCORE`` add a span of kind ``literal``. No length is bounded.

Defined results: a null or empty text has no spans; rows are independent, so
repeated rows give repeated results and an empty table an empty one; long texts
are scanned whole, in time linear in their length; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as sp
from .common import as_texts, renamed

KINDS = ("assign", "access", "hex", "literal")
MIN_SCORE = 1.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names and how sensitive a name with that part is. Fixed values.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "authkey": 0.9,
    "credential": 0.8, "bearer": 0.8, "auth": 0.5, "connectionstring": 0.7, "key": 0.4,
}
#: Last parts of names that tell something about a secret without holding it. Fixed values.
ABOUT = {"count", "length", "size", "limit", "index", "type", "kind", "name", "url", "uri", "path", "file", "field", "label", "policy", "hint", "ttl", "expiry", "timeout", "version", "format", "status"}
#: Values that stand for a secret without being one. Fixed values.
PLACEHOLDERS = {"changeme", "password", "secret", "example", "placeholder", "your_password", "yourpassword", "xxxxxxxx", "undefined", "required", "optional", "disabled", "enabled"}

_STRING = r"""\"(?:[^\"\\\n]++|\\.)*+\"|(?<![A-Za-z0-9])'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\\n]++|\\.)*+`"""
#: An escape outside of strings is a token, so that a quote that is escaped never opens a string. A quote without an
#: end fails once for each line at most, so that the pass is linear.
_TOKEN = re.compile(
    rf"""(?P<triple>\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|\'\'\'(?:[^'\\]++|\\.|'(?!''))*+\'\'\')"""
    rf"""|(?P<string>{_STRING})"""
    r"""|(?P<escaped>\\\"(?:[^\"\\\n]++|\\[^\"\n])*+\\\")"""
    r"""|(?P<escape>\\.)"""
    r"""|(?P<comment>/\*|\*/|//|--(?=\s)|<!--|-->)"""
    r"""|(?P<op>:=|=>|->|[=!<>]=|::|[=:(),+.\[\]{}|;?&<>])"""
    r"""|(?P<word>[$%@]?\{?[A-Za-z0-9_](?:[A-Za-z0-9_]|[.\-/+~=!@$^*#%&](?=[A-Za-z0-9_/+=]))*+)"""
    r"""|(?P<line>\n[ \t]*)""",
    re.S,
)
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*\Z")
_LEADING = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
#: The first and last line of a key in PEM form; their blanks are no sign of prose.
_ARMOUR = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----")
_XML = re.compile(r"<([A-Za-z_][A-Za-z0-9_.\-]*)>([^<>\s]{6,})</\1>")
_VALUE = re.compile(r"\s*<value>([^<>]{6,})</value>")
#: A line of a list: a string, or a bare value up to the end of the line.
_ITEM = re.compile(r"""[ \t]*\n[ \t]*-[ \t]+(?:"([^"\\\n]*)"|'([^'\\\n]*)'|([^\s"'#:,{}\[\]]+))[ \t]*(?=\n|\Z)""")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_SHORT = re.compile(r"[^\s\"'`,;(){}\[\]<>:=]+=*")
_ENVIRONMENT = re.compile(r"os\.environ|process\.env|ENV\b")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: A name is sensitive only with one of these in it, so that other texts need no lexing.
_MAYBE = re.compile("pass|pwd|secret|token|key|cred|bearer|auth|connection", re.I)
_ASSIGNS = (":=", "=>", "->", "=", ":")
_ENDS = {"/*": "*/", "//": "//", "<!--": "-->"}


def name_weight(name: str) -> float:
    """How sensitive a target name is, 0 to 1. Names are read as words: cut at case, digits and separators."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    parts = [x[:-1] if len(x) > 4 and x.endswith("s") and not x.endswith("ss") else x for x in parts]
    best = 0.0
    if len(parts) > 1 and parts[-1] in ABOUT:
        return best
    for i in range(len(parts)):
        joined = ""
        for part in parts[i : i + 3]:
            joined += part
            best = max(best, SENSITIVE.get(joined, 0.0))
        # Run-on names, such as dbpassword: long words count at the end of a part.
        best = max(best, max((w for x, w in SENSITIVE.items() if len(x) > 4 and parts[i].endswith(x)), default=0.0))
    return best


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def shape_weight(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1."""
    if len(value) < 6 or value.lower() in PLACEHOLDERS or len(set(value)) < 4 or value.startswith(("http://", "https://", "${", "<", "%")):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[0-9]", "[a-z]", "[A-Z]", r"[^A-Za-z0-9\s]"))
    spaces = _ARMOUR.sub("", value).count(" ")
    return min(1.0, entropy(value) / 4 + 0.15 * (kinds - 1) + min(len(value), 40) / 80) * (0.4 if spaces > 2 else 1.0) * (1.0 if kinds > 1 else 0.6)


def score(names: list[str], value: str) -> float:
    """The most sensitive of the names a value reaches, times two, times its shape."""
    return 2 * max(map(name_weight, names), default=0.0) * shape_weight(value)


class _Lexer:
    """Tokens of a text or of a part of it, and the pairs they form."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.end = text, end
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.found: list[tuple[str, str, list[tuple[str, int, int]]]] = []
        self.consumed = start  # tokens before this place belong to a block
        self.run_end = start  # of the last bare value
        self.behind: dict[int, int] = {}  # of comments, by their first token
        self.closers = {mark: [i for i, (kind, a, b) in enumerate(self.tokens) if (kind == "line" if mark == "//" else text.startswith(mark, a))] for mark in ("//", "*/", "-->")}

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def value(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if 0 <= i < len(self.tokens) else ""

    def is_string(self, i: int) -> bool:
        return self.kind(i) in ("triple", "string", "escaped")

    def inner(self, i: int) -> tuple[str, int, int]:
        """A string without its quotes, and its place."""
        kind, a, b = self.tokens[i]
        cut = {"triple": 3, "string": 1, "escaped": 2}[kind]
        return self.text[a + cut : b - cut], a + cut, b - cut

    def past_comment(self, i: int) -> int:
        """Behind the comments that begin at token i. A chain of comments is followed once."""
        path = []
        while i not in self.behind and self.kind(i) == "comment" and self.value(i) in _ENDS:
            path.append(i)
            own = self.closers[_ENDS[self.value(i)]]
            k = bisect_left(own, i + 1)
            i = own[k] + 1 if k < len(own) else len(self.tokens)
        i = self.behind.get(i, i)
        self.behind.update(dict.fromkeys(path, i))
        return i

    def next_line(self, i: int) -> int:
        """The string that stands alone on a line after token i; else i."""
        k = i
        while self.kind(k) == "line":
            k += 1
        return k if self.is_string(k) and self.value(k + 1) not in _ASSIGNS else i

    def unpacked(self, i: int) -> bool:
        """Pairs of several names with as many strings, around the operator at token i: ``[a, b] = ["x", "y"]``, ``a, b = "x", "y"``."""
        first = i - 1 - (self.value(i - 1) == "]")
        names = []
        while self.kind(first) == "word":
            names.append(self.value(first).lstrip("$@"))
            if self.value(first - 1) != ",":
                break
            first -= 2
        listed = self.value(i - 1) == "]"
        if not names or (self.value(first - 1) != "[" if listed else len(names) < 2 or self.kind(first - 1) not in ("line", "")):
            return False
        k, values = i + 1 + (self.value(i + 1) == "["), []
        while self.is_string(k) and len(values) < len(names):
            values.append(self.inner(k))
            k += 2 if self.value(k + 1) == "," else 1
        if len(values) < len(names) or self.is_string(k):
            return False
        self.found += [(name, "", [value]) for name, value in zip(reversed(names), values)]
        return True

    def items(self, name: str, at: int) -> bool:
        """The lines of a list below ``name:``, each a value of its own."""
        start = at
        while item := _ITEM.match(self.text, at, self.end):
            if item[3]:
                self.bare(name, item.start(3))
            else:
                k = 1 if item[1] is not None else 2
                self.found.append((name, "", [(item[k], item.start(k), item.end(k))]))
            at = item.end()
        self.consumed = max(self.consumed, at if at > start else start)
        return at > start

    def name_before(self, i: int) -> tuple[str, int]:
        """The name that ends at token i, and its first token."""
        if self.value(i) == "]":
            i -= 1
            if self.is_string(i):
                return self.inner(i)[0], i
        if self.value(i) in ("?", "!"):
            i -= 1
        if self.is_string(i):
            name = self.inner(i)[0]
            return (name if _IDENTIFIER.match(name) else ""), i
        if self.kind(i) == "word" and _IDENTIFIER.match(name := self.value(i).lstrip("$@")):
            return name, i
        return "", i

    def typed(self, i: int) -> int:
        """The equals sign of ``: Type =`` after a colon at token i; -1 without a type."""
        k, depth, words = i + 1, 0, 0
        while k < len(self.tokens) and self.kind(k) != "line":
            v = self.value(k)
            if v == "=" and not depth:
                return k if words else -1
            if v in ("[", "<"):
                depth += 1
            elif v in ("]", ">"):
                depth -= 1
            elif self.kind(k) == "word":
                if not _LEADING.match(v):
                    return -1
                words += 1
            elif self.kind(k) == "string" and self.value(k).startswith("'"):
                return -1
            elif v not in ("|", "?", "&", ".", ",", "::") or (v == "," and not depth):
                return -1
            k += 1
        return -1

    def literal(self, i: int) -> list[tuple[str, int, int]]:
        """The strings from token i on, adjacent or joined."""
        parts = []
        while True:
            i = self.past_comment(i)
            if not self.is_string(i):
                return parts
            parts.append(self.inner(i))
            i = self.past_comment(i + 1)
            k = i
            while self.value(k) in ("+", ".", "\\") or self.kind(k) in ("line", "escape"):
                k += 1
            if any(self.value(x) in ("+", ".") or self.kind(x) == "escape" for x in range(i, k)) or k == i:
                i = k
            else:
                return parts

    def block(self, i: int) -> list[tuple[str, int, int]]:
        """The lines of a block that is indented deeper than the line of token i."""
        text, at = self.text, self.tokens[i][1]
        line = text.rfind("\n", 0, at) + 1
        own = len(text[line:at]) - len(text[line:at].lstrip(" -"))
        parts, at = [], text.find("\n", self.tokens[i][2], self.end)
        while 0 <= at < self.end:
            nxt = text.find("\n", at + 1, self.end)
            stop = nxt if nxt >= 0 else self.end
            content = text[at + 1 : stop]
            if content.strip():
                if len(content) - len(content.lstrip(" ")) <= own:
                    break
                a = at + 1 + len(content) - len(content.lstrip())
                parts.append((content.strip(), a, a + len(content.strip())))
            at = nxt
        self.consumed = at if at >= 0 else self.end
        return parts

    def bare(self, name: str, a: int) -> None:
        """The pair of a name with the bare value at a: up to a blank or a bracket, or, where that run has been taken
        by a name before, up to the next separator."""
        found = (_BARE if a >= self.run_end else _SHORT).match(self.text, a, self.end)
        if not found or found[0][0] in "$%@" or _ENVIRONMENT.match(found[0]):
            return
        self.run_end = max(self.run_end, found.end())
        value = found[0].rstrip(".")
        reference = value if _IDENTIFIER.match(value) else ""
        self.found.append((name, reference, [] if reference and not any(c.isdigit() for c in value) else [(value, a, a + len(value))]))

    def assign(self, name: str, i: int, first: int) -> None:
        """The pair of a name with what follows its operator at token i; ``first``: the name's token."""
        if self.value(i) == ":" and self.kind(i + 1) == "line" and self.items(name, self.tokens[i][2]):
            return
        k = self.next_line(self.past_comment(i + 1))
        if self.value(i) == ":" and (self.value(k) in ("|", ">")) and self.kind(k + 1) in ("line", "") or (self.value(k) in ("|", ">") and self.value(k + 1) == "-"):
            if parts := self.block(first):
                self.found.append((name, "", parts))
            return
        # A prefix of a string, or calls around it.
        while self.kind(k) == "word" and (self.value(k + 1) == "(" or (self.is_string(k + 1) and self.tokens[k][2] == self.tokens[k + 1][1])):
            if re.search("env", self.value(k), re.I):
                return
            k += 1 + (self.value(k + 1) == "(")
        if self.value(k) == "new" and self.kind(k + 1) == "word" and self.value(k + 2) == "(":
            k += 3
        if parts := self.literal(k):
            self.found.append((name, "", parts))
        elif self.kind(k) == "word" and not self.text[self.tokens[k - 1][2] : self.tokens[k][1]].strip():  # no stray quote between
            self.bare(name, self.tokens[k][1])

    def pairs(self) -> list[tuple[str, str, list[tuple[str, int, int]]]]:
        key = ""  # the key attribute of the tag that is open
        i = 0
        while i < len(self.tokens):
            kind, a, b = self.tokens[i]
            if a < self.consumed:
                i += 1
                continue
            v = self.text[a:b] if kind == "op" else ""
            if kind == "word" and "=" in self.text[a:b]:
                # NAME=literal without a blank is one word.
                name, _, value = self.text[a:b].partition("=")
                if value.strip("=") and _IDENTIFIER.match(name) and self.kind(i - 1) != "op":
                    self.bare(name, a + len(name) + 1)
            elif v == "=" and self.value(i - 1) != ")" and (self.value(i - 1) == "]" or self.value(i - 2) == ",") and self.unpacked(i):
                pass
            elif v in _ASSIGNS:
                name, first = self.name_before(i - 1)
                if name:
                    target = self.typed(i) if v == ":" else -1
                    if target > 0:
                        self.assign(name, target, first)
                        i = target
                    elif name == "value" and v == "=" and key:
                        self.assign(key, i, first)
                        key = ""
                    else:
                        if name in ("key", "name") and v == "=" and self.is_string(i + 1):
                            key = self.inner(i + 1)[0]
                        self.assign(name, i, first)
            elif v == "(":
                name, first = self.name_before(i - 1)
                if name and not self.is_string(i - 1) and self.is_string(i + 1) and self.value(i + 2) != "," and re.match("set|with|put|add", name.rpartition(".")[2], re.I):
                    self.found.append((name, "", self.literal(i + 1)))
            elif v == "," and self.is_string(i - 1) and self.is_string(i + 1):
                name, _ = self.name_before(i - 1)
                if name:
                    self.found.append((name, "", self.literal(i + 1)))
            elif v == ">":
                if key and (value := _VALUE.match(self.text, b, self.end)):
                    self.found.append((key, "", [(value[1], value.start(1), value.end(1))]))
                key = ""
            i += 1
        return self.found


def assignments(text: str) -> list[tuple[str, str, list[tuple[str, int, int]]]]:
    """(name, reference or '', literal parts with their places) of each assignment in ``text``."""
    lexer = _Lexer(text, 0, len(text))
    found = list(lexer.pairs())
    for i in range(len(lexer.tokens)):
        if lexer.is_string(i):
            inner, a, b = lexer.inner(i)
            if ("=" in inner or ":" in inner) and _MAYBE.search(inner):
                found += _Lexer(text, a, b).pairs()
    if "</" in text:
        found += [(m[1], "", [(m[2], m.start(2), m.end(2))]) for m in _XML.finditer(text)]
    return found


def resolved(found: list[tuple[str, str, list[tuple[str, int, int]]]]) -> list[list[tuple[str, int, int]]]:
    """The literal parts of each assignment, references followed: to the last value before, else to the first after."""
    places: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(found):
        places.setdefault(name, []).append(i)
    ends: dict[int, list[tuple[str, int, int]]] = {}
    for i in range(len(found)):
        path, at = {}, i
        while at not in ends:
            path[at] = None
            own = places.get(found[at][1], ())
            after = own[max(0, bisect_left(own, at) - 1)] if own else at
            if after in path:  # a constant, an unknown name, or a ring of names
                ends[at] = found[at][2]
                break
            at = after
        for k in path:
            ends[k] = ends[at]
    return [ends[i] for i in range(len(found))]


def lexed(text: str) -> list[sp.Span]:
    """Spans of the literals whose score reaches ``MIN_SCORE``, after propagating constants."""
    if not _MAYBE.search(text):
        return []
    targets: dict[tuple[int, int], tuple[str, list[str]]] = {}
    found = assignments(text)
    for (name, _, _), parts in zip(found, resolved(found)):
        whole = "".join(p[0] for p in parts)
        for _, a, b in parts:
            targets.setdefault((a, b), (whole, []))[1].append(name)
    return [("literal", a, b) for (a, b), (whole, names) in targets.items() if b > a and score(names, whole) >= MIN_SCORE]


def base_spans(text: str) -> list[sp.Span]:
    """The three base kinds, each leftmost and without overlaps; matches that are too short are dropped."""
    low = text.lower()
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if any(w in low for w in _ASSIGN_WORDS) else []
    # A run that is too short fails from each of its starts, so the length can stand in the pattern.
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base = [base_spans(x) for x in as_texts(batch.column(1))]
        every = [b + lexed(x) for b, x in zip(base, as_texts(batch.column(1)))]
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS[:3]]
        texts = [pa.array([f(s, KINDS) for s in x], pa.string()) for f, x in ((sp.digest, base), (sp.joined, every))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *texts], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans, per row of ``docs``."""
    rows = renamed(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(_scanned, f"doc_id {dict(rows.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text column replaced by its kind in brackets; null stays null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda x: x if x is None else sp.replace(x, base_spans(x) + lexed(x)))

    return docs.withColumn(text_col, clean(F.col(text_col)))
