"""Secret scans: base patterns plus assignment-aware lexing.

The base kinds are fixed patterns.  The method reads a text as source or
configuration: a lexer turns it into name-literal pairs (assignments,
mappings, subscripts, flags, attributes), constants are propagated through names (all
values assigned to one so far) and concatenations of any length, and a literal is scored by how sensitive the names are that it
reaches and by its own shape; one with white space by its parts, a private key
in PEM by its header.  Unquoted values go to the end of the line, YAML blocks to
the end of the block, and strings are read for assignments inside of them.  Literals that score enough are reported as kind
``literal`` unless a base span already covers them.

Defined results: a null or empty text has no spans; spans are in code points,
end exclusive, ordered by start and then kind; equal texts have equal spans;
an empty table gives no rows; a text is lexed whole, in time linear in it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import slices

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_HEX_CLASS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; those too short are dropped."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if text.encode("utf-8", "surrogatepass").translate(_HEX_CLASS).find(b"\x01" * 32) >= 0:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return out


# ---- lexing ----

#: Tokens of common source and configuration syntax.  Strings end at their quote or the line.
_TRIPLE = r"""(?P<triple>\"\"\"(?:\\.|(?!\"\"\")[^\\])*\"\"\"|'''(?:\\.|(?!''')[^\\])*''')"""
_STRING = r"""(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\\n])*`)"""
_REST = r"""(?P<op>:=|=>|->|[=!<>]=|[=:+,;(){}\[\]<>])
  | (?P<line>\n)
  | (?P<blank>[^\S\n]+)
  | (?P<word>[^\s"'`:=+,;(){}\[\]<>]+)
  | (?P<other>["'`])"""
TOKEN, _NO_TRIPLE, _NO_STRING = (re.compile(" | ".join(p), re.X | re.S) for p in ((_TRIPLE, _STRING, _REST), (_STRING, _REST), (_REST,)))
#: Where a string or a triple-quoted string can end: what an even number of backslashes stands before.
_STOPS = {q: re.compile(rf"(?<!\\)(?:\\\\)*(?=[{q}\n])") for q in "\"'`"} | {q: re.compile(rf"(?<!\\)(?:\\\\)*(?={q})") for q in ('"""', "'''")}


def tokens(text: str) -> Iterator[re.Match]:
    """Tokens of a text, as ``TOKEN`` finds them, in time linear in it.

    A quote that is never closed would be searched for up to the end of the text, and
    that again for each such quote.  So the places where a quote can end are listed
    once, and one that has no end is not tried."""
    if "\\" not in text and '"""' not in text and "'''" not in text:
        yield from TOKEN.finditer(text)  # strings end with their line
        return
    stops: dict[str, list[int]] = {}

    def closes(quote: str, at: int) -> bool:
        if quote not in stops:
            stops[quote] = [m.end() for m in _STOPS[quote].finditer(text)]
        i = bisect_left(stops[quote], at + len(quote))
        return i < len(stops[quote]) and text.startswith(quote, stops[quote][i])

    at = 0
    while at < len(text):
        use = TOKEN
        if text[at] in "\"'`":
            q = text[at]
            if q == "`" or not text.startswith(q * 3, at) or not closes(q * 3, at):
                use = _NO_TRIPLE if closes(q, at) else _NO_STRING
        m = use.match(text, at)
        yield m
        at = m.end()


#: Name parts and the weight they give to what is assigned to them.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "secrets": 3, "token": 3, "apikey": 3, "credential": 3,
    "credentials": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3, "encryptionkey": 3, "signingkey": 3, "authkey": 3, "connectionstring": 3,
    "bearer": 2, "auth": 2, "authorization": 2, "private": 1, "access": 1, "api": 1, "encryption": 1, "signing": 1, "client": 1, "key": 1, "dsn": 2, "salt": 1,
}
#: Names that speak about a secret without holding it.
HARMLESS = {"file", "path", "name", "type", "url", "uri", "length", "len", "size", "count", "expiry", "expires", "ttl", "timeout", "policy", "hint", "label", "field", "id", "regex", "format", "max", "min", "public"}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|\$[A-Z_]+|null|none|nil|true|false|undefined|changeme|change_me|example|placeholder|dummy|test|todo|your[_-].*|enter[_-].*)$")
#: A name given with one or two dashes; its value is the next word or string.
FLAG = re.compile(r"--?([A-Za-z][\w.-]*)$")
FLAG_IN_TEXT = re.compile(r"""(?<![^\s"'`\[(,])--?[A-Za-z]""")
OPENS = re.compile(r"[^\S\n]*:?=(?![=>])")  # what gives f(name) a value; f(name): and f(name) => do not
BRACKETS = {"]": "[", ")": "(", ">": "<"}
#: A private key in PEM is a secret whatever holds it.
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_VALUE = re.compile(r"[^\S\n]*(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)")
PEM_END = re.compile(r"-----END [A-Z0-9 ]*-----")
#: ``name: |`` and the like; the value is the indented lines below.
BLOCK = re.compile(r"[^\S\n]+[|>][-+0-9]*[^\S\n]*(?:#[^\n]*)?\n")
_INDENT = re.compile(r"[^\S\n]*")
RUN = re.compile(r"""[^\s"'`]+""")
#: Strings whose text may hold assignments of its own, as a header or a command line.
WITHIN = re.compile(r"(?i)pass|pwd|secret|token|key|cred|auth|dsn|salt|connection")
QUOTE = re.compile("[\"'`]")
PARTED = re.compile(r"[\s:=]")
#: Names whose value may be plain words, and words that make those a prompt or a message.
PHRASES = {"passphrase", "password", "passwd", "pwd"}
PROMPT = set("a an and are at be cannot change characters confirm do does enter forgot for hide in incorrect invalid is least length match may missing must new no not of on or "
             "please reset required requires short show strong the this to too type use weak with wrong you your".split())
SURE = 10.0
THRESHOLD = 4.0
MIN_LITERAL = 8
#: A name brings so many characters of its value to the shape of a concatenation it is part of, a literal
#: all of its own.  Every literal of both is reported, and each is scored on its own as well.
HEAD = 256
#: What stands between ``name:`` and ``=`` in typed code; such a word holds no value itself.
TYPES = {"string", "str", "char", "bytes", "byte", "text", "any", "auto", "const", "var", "object", "int", "number"}
#: A concatenation goes on behind the line break.
GOES_ON = re.compile(r"\s*\+")


def name_score(name: str) -> float:
    """Sensitivity of a target name by its parts (camelCase, snake_case, dotted)."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    score = sum(SENSITIVE.get(p, 0) for p in set(parts))
    flat = "".join(parts)
    return float(max([score, *(w for k, w in SENSITIVE.items() if len(k) > 6 and flat.endswith(k))]))


def literal_score(value: str) -> float:
    """-4 to 3 by shape: length, symbol classes, entropy; placeholders sink, a private key is ``SURE``."""
    pem = PEM.search(value) if "-----BEGIN" in value else None
    if pem and len(value) >= pem.end() - pem.start() + 16:
        return SURE
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value) or len(set(value)) < 4:
        return -4.0
    if any(c.isspace() for c in value):
        return -2.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (entropy >= 2.5) + (entropy >= 3.5) + (classes >= 2) * 1.0 - (classes == 1 and value.isalpha()) * 1.0


def is_phrase(value: str) -> bool:
    """Three or more plain words that are neither a prompt nor a message."""
    found = value.split()
    return len(found) >= 3 and all(w.isalnum() and w not in PROMPT and not name_score(w) for w in map(str.lower, found))


def runs(text: str, start: int, end: int, first: bool = True) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of the parts between white space that do not look like words.
    A part behind a word such as Bearer counts that word as well."""
    said = 0
    some = 0
    rows = []
    for m in RUN.finditer(text, start, end):
        word = m[0].strip(".,;:!?()[]{}<>")
        s = m.start() + m[0].find(word) if word else m.start()
        score = -4.0
        if (len(word) >= MIN_LITERAL and ("://" not in word or "@" in word) and not word.startswith(("/", "./", "#"))
                and (re.search(r"\d", word) and re.search(r"[^\W\d_]", word) or len(word) >= 16 and re.search(r"[a-z][A-Z]", word))):
            score = literal_score(word)
        if (first or some) and score > 0:
            rows.append((s, s + len(word), score + said))
        some += 1
        said = SENSITIVE.get(word.lower(), 0)
    if first and some > 2 and len(rows) == some - 1 and rows[-1][1] < m.start():  # text wrapped into lines, the last one short
        rows = [(rows[0][0], m.end(), max(r[2] for r in rows))]
    yield from rows


def pairs(text: str) -> Iterator[tuple[list[str], tuple[str, ...], list[tuple]]]:
    """(target names, names that only tell about the value, operands) of each
    assignment-like construct.  An operand is ("literal", (start, end)), ("word",
    (word, start, end)) or ("name", name); several come from ``+`` and adjoining strings.
    ("rest", (start, end)) is an unquoted value of several words, without its first word's claim."""
    before: list[tuple] = []  # words and strings since the last separator on the line
    target: str | None = None
    operands: list = []
    chain: list[str] = []  # names in front of the target: a = b = value, name: type = value
    hints: tuple[str, ...] = ()  # variable keys and the name of their table
    joined = False
    grouped = False  # name = ( over several lines
    plus = -1
    first = -1  # where an unquoted value starts that has a second word
    unquoted = -1
    taken = 0  # end of the last block or key below a name
    ended = True  # a private key's end mark may still come
    opener = ""
    inside: list[tuple[str, str]] = []  # open brackets and the name each follows
    typed: tuple | None = None  # name: type[..., kept until the bracket ends

    def flag(word: str) -> str:
        found = FLAG.match(word)
        return found[1] if found and name_score(found[1]) > 0 else ""

    def flush(at: int):
        nonlocal first, unquoted
        if operands and (target or chain or hints):
            yield [target, *chain], hints, operands
            if first >= 0 and at > first:
                yield [], (target or "", *chain, *hints), [("rest", (first, at))]
        first = unquoted = -1

    for m in tokens(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "blank":
            continue
        if kind in ("string", "triple"):
            q = 3 if kind == "triple" else 1
            adjoins = operands and operands[-1][0] == "literal" and opener != "flag" and before and before[-1][0] == "string"
            if target is not None and (not operands or joined or adjoins):
                operands.append(("literal", (start + q, end - q)))
                joined = False
            before = [("string", text[start + q:end - q], start, end)]
            continue
        if kind == "word":
            word = m[0]
            if opener == "flag" and target is not None and not operands and FLAG.match(word):
                target = None  # a flag without a value
            if flag(word):
                yield from flush(start)
                target, operands, joined, opener, chain, hints, grouped, before = flag(word), [], False, "flag", [], (), False, [("word", word, start, end)]
                continue
            if target is not None and (not operands or joined):
                plain = word.rstrip(".,;!?")
                if not operands and opener != "flag":
                    unquoted = start
                if opener in ("=", ":", ":=", "=>", "flag") and not re.match(r"[A-Za-z_][A-Za-z0-9_.]*$", plain):
                    operands.append(("literal", (start, start + len(plain))))
                elif plain:
                    operands.append(("word", (plain, start, start + len(plain))))
                joined = False
            elif unquoted >= 0 and target is not None:
                first = unquoted
            before.append(("word", word, start, end))
            del before[:-3]
            continue
        op = m[0] if kind == "op" else ""
        if op == "+":
            joined, plus = target is not None and bool(operands), end
            continue
        if op in ("=", ":", ":=", "=>") and before and (target is None or op != ":"):
            name = before[-1][1].lstrip("-$@")
            if target is not None and len(operands) == 1 and operands[0][0] == "word" and operands[0][1][0] == before[-1][1]:
                chain.append(target)
                first = unquoted = -1
            elif target is not None and not operands and before[-1][0] == "key":
                chain.append(target)  # a = table[key] = value
            else:
                yield from flush(start)
                chain, hints = [], ()
            hints += before[-1][4:]
            more = op == "=" and plus == start  # name += value
            target, operands, joined, opener, before, grouped = name, [("name", name)] if more else [], more, op, [], False
            if end < taken:
                continue
            key = PEM_VALUE.match(text, end)
            if key:  # a private key without quotes
                stop = PEM_END.search(text, key.end()) if ended else None
                ended = stop is not None
                taken = stop.end() if stop else key.end()
                operands.append(("literal", (key.start(1), taken)))
            elif op == ":" and name_score(name) > 0 and BLOCK.match(text, end):
                s, taken = block(text, text.rfind("\n", 0, start) + 1, text.index("\n", end) + 1)
                operands.append(("literal", (s, taken)))
            if key or operands and op == ":":
                yield from flush(start)
                target, operands, chain, hints = None, [], [], ()
            continue
        if op == ":" and target is not None and not operands and before == []:
            continue  # "::"
        if kind == "line" and (joined or grouped or operands and GOES_ON.match(text, end)):
            continue
        if op == "(" and target is not None and not operands and opener != "flag" and not before:
            inside.append((op, ""))
            grouped = True
            continue
        if op in ("[", "(", "<"):
            base = before[-1] if before and before[-1][3] == start else None
            inside.append((op, "" if not base else base[1].rpartition(".")[2] if base[0] == "string" else base[1]))
            if base and typed is None and op != "(" and target is not None and opener == ":" and [x[0] for x in operands] == ["word"]:
                typed = len(inside), target, operands, chain, hints, base
                target, operands, joined, before, chain, hints = None, [], False, [], [], ()
                continue
        if op in BRACKETS and inside and inside[-1][0] == BRACKETS[op]:
            if typed and typed[0] == len(inside):
                inside.pop()
                _, target, operands, chain, hints, base = typed
                joined, opener, before, typed = False, ":", [(*base[:3], end)], None
                continue
            base, last = inside.pop()[1], before[-1] if before and op != ">" else None
            yield from flush(start)
            target, operands, joined, chain, hints, grouped = None, [], False, [], (), False
            if last is None or last[0] == "word" and last[1].isdigit():
                before = [("word", base, start, end)] if base else []
            elif last[0] == "string":  # the key says whether a table of secrets holds one there
                before = [("string", f"{base}.{last[1]}", start, end)] if op == "]" else [("string", last[1], start, end)]
            else:  # a variable as key: it or the name in front may tell
                before = [("key", "", start, end, last[1], base)]
            if op == ")":
                after = OPENS.match(text, end)
                before = before if after else []
            continue
        if op in ("<", ">", "[", "]", "(", ")", "{", "}", ",", ";") or kind in ("line", "other"):
            yield from flush(start)
            if typed and kind == "line":
                _, target, operands, chain, hints, _ = typed
                typed = None
                yield from flush(start)
            told = flag(before[-1][1]) if op == "," and before and before[-1][0] == "string" else ""
            target, operands, joined, before, chain, hints, grouped = told or None, [], False, [], [], (), False
            opener = "flag" if told else opener
    yield from flush(len(text))


def block(text: str, line: int, at: int) -> tuple[int, int]:
    """The lines from ``at`` on that are indented as the first of them, and more than ``line``."""
    def indent(s: int) -> int:
        return len(_INDENT.match(text, s)[0])

    over, depth, start, end = indent(line), 0, at, at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        here = indent(at)
        if at + here < stop:
            if here <= over or here < depth:
                break
            if not depth:
                depth, start = here, at + here
            end = stop
        at = stop + 1
    return start, max(start, end)


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name directly or through constants."""
    if "=" not in text and ":" not in text and not FLAG_IN_TEXT.search(text):
        return []
    out = _own_spans(text)
    # headers, command lines and the like inside of strings
    for m in tokens(text) if WITHIN.search(text) and QUOTE.search(text) else ():
        if m.lastgroup in ("string", "triple"):
            q = 3 if m.lastgroup == "triple" else 1
            s, e = m.start() + q, m.end() - q
            if e - s > MIN_LITERAL and WITHIN.search(text, s, e) and PARTED.search(text, s, e):
                out += [(k, s + a, s + b) for k, a, b in _own_spans(text[s:e])]
    return list(dict.fromkeys(out))


def _own_spans(text: str) -> list[Span]:
    """What the assignments of a text itself say, without those inside of its strings."""
    nodes: list[tuple[str, tuple]] = []  # literals, values of operands, and the values of a name up to a point
    weight: list[float] = []
    env: dict[str, int] = {}  # name: node of all its values so far, shared by those who use the name
    scores: dict[str, float] = {}
    phrase: list[int] = []  # values that may be plain words

    def node(kind: str, parts: tuple, names: float = 0.0) -> int:
        nodes.append((kind, parts))
        weight.append(names)
        return len(nodes) - 1

    for targets, hints, operands in pairs(text):
        parts, sure = [], False
        for kind, what in operands:
            name = what if kind == "name" else what[0] if kind == "word" else None
            if name in env:
                parts.append(env[name])
            elif kind != "name":
                s, e = what[-2:]
                if e > s:
                    parts.append(node("rest" if kind == "rest" else "literal", (s, e)))
                    sure = sure or "-----BEGIN" in text[s:e] and PEM.search(text, s, e) is not None
        if not parts:
            continue
        for name in (*targets, *hints):
            if name not in scores:
                scores[name] = name_score(name)
        value = node("value", tuple(parts), max([THRESHOLD * sure, *(scores[n] for n in (*targets, *hints))]))
        phrase.append(value) if any(PHRASES & set(re.split(r"[^a-z]+", n.lower())) for n in (*targets, *hints) if scores[n] > 0) else None
        for name in targets:
            if name and name not in TYPES:
                env[name] = node("name", (value, env[name]) if name in env else (value,))
    if not any(weight):
        return []

    # a node comes after its parts: weights go down from the names, shapes up from the literals, scores of joined values down
    wordy = set(phrase)
    for i in range(len(nodes) - 1, -1, -1):
        kind, parts = nodes[i]
        if weight[i] > 0 and kind not in ("literal", "rest"):
            for p in parts:
                weight[p] = max(weight[p], weight[i])
            if i in wordy and (kind == "name" or len(parts) == 1):
                wordy.update(parts)
    head = [""] * len(nodes)
    shape = [-4.0] * len(nodes)
    for i, (kind, parts) in enumerate(nodes):
        if weight[i] <= 0:
            continue
        if kind == "rest":
            continue
        if kind == "literal":
            head[i], shape[i] = text[parts[0]:min(parts[1], parts[0] + HEAD)], literal_score(text[parts[0]:parts[1]])
        elif len(parts) == 1:
            head[i], shape[i] = head[parts[0]], shape[parts[0]]
        elif kind == "name":  # of several values, the most telling one stands in concatenations
            best = max(parts, key=lambda p: (shape[p], len(head[p])))
            head[i], shape[i] = head[best], shape[best]
        else:
            whole = "".join([text[slice(*nodes[p][1])] if nodes[p][0] == "literal" else head[p] for p in parts])
            head[i], shape[i] = whole[:HEAD], max([literal_score(whole), *(x for _, _, x in runs(whole, 0, len(whole)) if len(whole.split()) > 1)])
    total = [-9.0] * len(nodes)
    reach: dict[tuple[int, int], float] = {}
    for i in range(len(nodes) - 1, -1, -1):
        kind, parts = nodes[i]
        if weight[i] <= 0:
            continue
        if kind in ("literal", "rest"):
            value = text[slice(*parts)]
            several = len(value.split()) > 1
            own = weight[i] + shape[i] if kind == "literal" else -9.0
            if total[i] >= SURE or not several and not (value != value.strip() and value.strip().isalpha()):
                own = max(own, total[i])
            if several and own < THRESHOLD:
                for s, e, score in runs(text, *parts, first=kind == "literal"):
                    reach[s, e] = max(reach.get((s, e), -9.0), weight[i] + score)
                if i in wordy and weight[i] >= 3 and is_phrase(value):
                    own = THRESHOLD
            reach[parts] = max(reach.get(parts, -9.0), own)
            continue
        if kind == "value" and len(parts) > 1:
            total[i] = max(total[i], weight[i] + shape[i])
        for p in parts:
            total[p] = max(total[p], total[i])
    return [("literal", s, e) for (s, e), score in reach.items() if score >= THRESHOLD]


def find_spans(text: str | None) -> list[Span]:
    """Base spans and the method's, by start and then kind."""
    text = text or ""
    base = sorted(base_spans(text), key=lambda x: x[1])
    starts = [s for _, s, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # furthest end of the spans that start so far
    extra = []
    for x in literal_spans(text):
        i = bisect_right(starts, x[1])
        if not i or reach[i - 1] < x[2]:
            extra.append(x)
    return sorted(base + extra, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every covered run replaced by one mark."""
    out, at = [], 0
    for _, s, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[redacted]"]
        at = e
    return "".join(out) + text[at:]


def scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), with_redacted: bool = False) -> DataFrame:
    """The ``keep`` columns with ``spans`` (kind, start, end) and, if asked, the redacted text (null stays null)."""
    src = df.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c) for c in keep])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            texts = b.column("_text").to_pylist()
            found = [find_spans(t) for t in texts]
            cols = [b.column(c) for c in keep] + [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], kind)]
            if with_redacted:
                cols.append(pa.array([t if t is None or not x else redact(t, x) for t, x in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*keep, "spans"] + ["redacted"] * with_redacted)

    schema = (fields + ", " if fields else "") + "spans array<struct<kind: string, start: bigint, end: bigint>>" + ", redacted string" * with_redacted
    return src.mapInArrow(run, schema)
