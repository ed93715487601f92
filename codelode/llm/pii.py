"""Operator 6: personal data by a semi-Markov conditional random field.

Segments, not tokens, are labelled: a candidate is a span of tokens (runs of letters and digits,
single blanks, other single characters), and its features look at the whole span: shape of its digit groups, check
digits, ranges of octets, domain endings, what stands at its borders and before it. A segment of no entity is one token
and scores 0. Dynamic programming over all segmentations chooses borders and types together. The weights are fitted
here by gradient ascent of the exact segmentation likelihood, on generated lines.

Candidates are bounded: spans of at most MAX_TOKENS tokens that no entity's form rules out (_OPEN, MOST_GROUPS, one "@", digits enough), and besides,
of any length, the longest addresses and dotted keys at each place (_LONG), so no entity is cut for its number of tokens. A place so begins at most MAX_TOKENS + 1 candidates, however long the text.

A candidate holds a digit or "@", has no two blanks together, and each of its blank-separated pieces holds one too. So
entities lie in runs of such pieces; elsewhere all segments are of no entity, and leaving those stretches out of the
dynamic programme changes nothing (tests compare it with one over whole texts).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick
from .textops import buffers, slices

TYPES = ["EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN"]
MAX_TOKENS = 17
#: Groups of digits in a span without letters.
MOST_GROUPS = 5
#: Characters that entities are made of; another one ends all spans before it.
_OPEN = frozenset(" @._%+()-")
#: Addresses and keys in parts, whole.
_LONG = re.compile(r"(?a)(?<![A-Za-z0-9._%+@-])(?:[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9@])|[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,})+(?![A-Za-z0-9._@-])|[A-Za-z0-9_-]{24,}(?![A-Za-z0-9._@-]))")
SEED = 7
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
_CONTEXT = 24
_KEYWORDS = re.compile(r"(?i)(token|secret|api[_-]?key|key|passwd|password|pwd|bearer|auth|credential)\W*$")
_SAYS = {"PHONE": re.compile(r"(?i)(phone|tel|call|mobile|fax|cell)\W*$"), "SSN": re.compile(r"(?i)(ssn|social security)\W*$"), "CARD": re.compile(r"(?i)(card|visa|credit)\W*$")}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _mod97(s: str) -> bool:
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


#: Spans of more characters are not kept in the cache, which so takes some 15 MB in each worker; it outlives its tasks.
_CACHED = 80


def features(span: str, left: str, right: str, before: str) -> tuple[str, ...]:
    """Names of the features of one whole span, between the characters left and right, after the text before."""
    return (_features if len(span) <= _CACHED else _features.__wrapped__)(span, left, right, before)


@lru_cache(maxsize=1 << 14)
def _features(span: str, left: str, right: str, before: str) -> tuple[str, ...]:
    digits = re.sub(r"\D", "", span)
    groups = re.findall(r"\d+", span)
    f = ["bias"]
    tight = not (left.isalnum() or right.isalnum())
    f.append("edges:free" if tight else "edges:glued")
    if left and left in "@.-_+" or right and right in "@_":
        f.append("edges:joined")
    if right in ".-" and len(right):
        f.append("edge:punct")
    if "@" in span:
        m = re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)\.([A-Za-z]{2,})", span)
        f.append("mail:whole" if m else "mail:part")
        f.append("mail:one" if span.count("@") == 1 else "mail:many")
        if " " in span:
            f.append("mail:blank")
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", span):
        f.append("ip:octets" if all(int(g) <= 255 for g in groups) else "ip:over")
    if not re.search("[A-Za-z@]", span):
        shape = "-".join(str(len(g)) for g in groups)
        if span[:1] == "+":
            f.append("starts:plus")
        if "(" in span:
            f.append("paren:pair" if re.search(r"\(\d+\)", span) else "paren:odd")
        if shape in ("1-3-3-4", "3-3-4", "2-3-3-4", "3-4"):
            f.append("shape:" + shape)
            f.append("nanp")
        elif re.fullmatch(r"\+?[\d ().-]+", span) and span[:1] == "+" and 9 <= len(digits) <= 15:
            f.append("shape:international")
        if shape == "3-2-4":
            f.append("shape:3-2-4" + ("dash" if span.count("-") == 2 else ""))
        if len(digits) in range(13, 20) and (len(groups) == 1 or shape in ("4-4-4-4", "4-6-5")):
            f.append("card:" + ("check" if luhn(digits) else "nocheck"))
            f.append(f"card:{len(digits)}" + ("g" if len(groups) > 1 else ""))
        f.append("digits:" + str(min(len(digits) // 2, 10)))
        if not re.match(r"[+(\d]", span) or not span[-1:].isdigit():
            f.append("ends:odd")
        if re.search(r"[^\d ().+-]", span):
            f.append("chars:odd")
        if re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}", span):
            f.append("date")
        if len(groups) == 1:
            f.append("single")
    elif re.fullmatch(r"[A-Za-z0-9_-]+", span) and "@" not in span:
        n = len(span)
        hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span)
        if n >= 16:
            f.append(f"key:{'hex' if hexa else 'any'}:{min(n // 8, 6)}")
            f.append("key:entropy:" + str(int(_entropy(span))))
            f.append("key:digits:" + str(min(4, 10 * len(digits) // n)))
        else:
            f.append("word")
        if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", span):
            f.append("iban:" + ("check" if _mod97(span) else "nocheck"))
        if re.match(r"(sk|pk|ghp|gho|xox[bap]|AKIA)[_-]?", span) and n >= 16:
            f.append("key:prefix")
    elif "@" not in span and re.fullmatch(r"[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{8,})+", span):
        f.append("dotted:" + str(min(span.count("."), 3)))
        f.append("dotted:entropy:" + str(int(_entropy(span))))
    elif re.fullmatch(r"[A-Z]{2}\d{2}(?: [A-Z0-9]{1,4})+", span):
        f.append("iban:" + ("check" if _mod97(span.replace(" ", "")) else "nocheck"))
    else:
        f.append("mixed")
    if _KEYWORDS.search(before):
        f.append("after:key")
        if len(span) >= 16 and "@" not in span and " " not in span:
            f.append("after:key:long")
    for name, pattern in _SAYS.items():
        if pattern.search(before):
            f.append("after:" + name)
    return tuple(f)


def candidates(tokens: list[str], before: str = "") -> list[tuple[int, int, tuple[str, ...]]]:
    """(begin, end, features) of the spans that may be entities."""
    text = "".join(tokens)
    at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).tolist()
    trigger = [any(c.isascii() and c.isdigit() or c == "@" for c in t) for t in tokens]
    blank = [t.isspace() for t in tokens]
    digits = [sum(c.isascii() and c.isdigit() for c in t) if len(t) < 40 else 40 for t in tokens]
    letters = [t[0].isascii() and t[0].isalnum() and not t.isdigit() for t in tokens]
    out = []

    def add(i: int, j: int) -> None:
        s, e = at[i], at[j + 1]
        left = text[s - 1 : s] or before[-1:]
        out.append((i, j + 1, features(text[s:e], left, text[e : e + 1], (before + text[max(0, s - _CONTEXT) : s])[-_CONTEXT:])))

    long = {m.start(): m.end() for m in _LONG.finditer(text)} if len(tokens) > MAX_TOKENS else {}
    for i, t in enumerate(tokens):
        if blank[i] or not (t[0].isascii() and t[0].isalnum() or t in "+("):
            continue
        piece, seen, n, groups, dots, ats, word = False, False, 0, 0, 0, 0, False
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            last = tokens[j]
            if blank[j]:
                if not piece or last != " ":
                    break
                piece = False
                continue
            if not (last[0].isascii() and last[0].isalnum()) and last not in _OPEN:
                break
            piece, seen = piece or trigger[j], seen or trigger[j]
            n, groups, dots, ats, word = n + digits[j], groups + (digits[j] > 0), dots + (last == "."), ats + (last == "@"), word or letters[j]
            if ats > 1 or groups > MOST_GROUPS and not word:
                break
            # numbers of less digits are no entity, but addresses of hosts; what has letters is an address, or long
            if (ats or n >= 7 or dots == 3 or word and at[j + 1] - at[i] >= 16) and piece and seen and last[0].isascii() and last[0].isalnum():
                add(i, j)
        if at[i] in long:
            e = long[at[i]]
            j = bisect_left(at, e) - 1
            if j >= i + MAX_TOKENS and at[j + 1] == e and any(trigger[i : j + 1]):
                add(i, j)
    return out


Model = dict[str, np.ndarray]


def _scores(model: Model, cands: list) -> np.ndarray:
    zero = np.zeros(len(TYPES))
    return np.array([sum((model.get(f, zero) for f in c[2]), zero) for c in cands]).reshape(-1, len(TYPES))


def decode(model: Model, tokens: list[str], before: str = "") -> list[tuple[int, int, str]]:
    """The best segmentation's entities (begin, end, type). Of equal scores: fewer entity tokens, then the longer segment, then the earlier type."""
    cands = candidates(tokens, before)
    s = _scores(model, cands)
    ends: dict[int, list[int]] = {}
    for k, c in enumerate(cands):
        if s[k].max() > 0:
            ends.setdefault(c[1], []).append(k)
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for e in range(1, len(tokens) + 1):
        best[e] = best[e - 1]
        for k in ends.get(e, ()):
            v = best[cands[k][0]] + float(s[k].max())
            if v > best[e] + 1e-12:
                best[e], back[e] = v, k
    out, e = [], len(tokens)
    while e:
        if back[e] is None:
            e -= 1
        else:
            k = back[e]
            out.append((cands[k][0], cands[k][1], TYPES[int(s[k].argmax())]))
            e = cands[k][0]
    return out[::-1]


def _gradient(model: Model, tokens: list[str], gold: set[tuple[int, int, str]]) -> tuple[float, list[tuple[tuple[str, ...], np.ndarray]]]:
    """Log likelihood of a segmentation, and for each candidate the observed less the expected counts by type."""
    cands = candidates(tokens)
    s = _scores(model, cands)
    n = len(tokens)
    begins: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for k, c in enumerate(cands):
        begins.setdefault(c[0], []).append(k)
        ends.setdefault(c[1], []).append(k)
    total = np.logaddexp.reduce(s, 1) if len(cands) else np.zeros(0)
    a, z = np.zeros(n + 1), np.zeros(n + 1)
    for e in range(1, n + 1):
        a[e] = np.logaddexp.reduce([a[e - 1], *[a[cands[k][0]] + total[k] for k in ends.get(e, ())]])
    for b in range(n - 1, -1, -1):
        z[b] = np.logaddexp.reduce([z[b + 1], *[z[cands[k][1]] + total[k] for k in begins.get(b, ())]])
    ll, out = -a[n], []
    for k, (b, e, f) in enumerate(cands):
        g = -np.exp(a[b] + s[k] + z[e] - a[n])
        for y, name in enumerate(TYPES):
            if (b, e, name) in gold:
                g[y] += 1
                ll += s[k, y]
        if np.abs(g).max() > 1e-4:
            out.append((f, g))
    return float(ll), out


def _generate(rng: np.random.Generator) -> list[tuple[str, str | None]]:
    """A line as pieces (text, type or None)."""
    pick1 = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n, s="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(list(s), n))
    word = lambda: letters(int(rng.integers(1, 11)))

    def card() -> str:
        x = pick1("4", "5", "37", "6011", "2") + num(20)
        x = x[: pick1(15, 16, 16, 16)]
        if rng.random() < 0.6:
            x = next(x[:-1] + d for d in "0123456789" if luhn(x[:-1] + d))
        return x if rng.random() < 0.6 or len(x) < 16 else pick1(" ", "-").join(x[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick1(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"+1 {a} {b} {c}", f"{a}.{b}.{c}", f"+{pick1('44', '49', '33', '34')} {num(3)} {num(3)} {num(4)}", f"+{pick1('44', '49', '33', '34')} {num(2)} {num(8)}")

    def secret() -> str:
        n = int(rng.integers(24, 65))
        part = lambda k: letters(k, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_")
        if rng.random() < 0.15:
            return "eyJ" + letters(17, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + "." + part(int(rng.integers(10, 60))) + "z." + part(int(rng.integers(20, 43))) + "0"
        return pick1(letters(n, "0123456789abcdef"), letters(40, "0123456789abcdef"), letters(32, "0123456789abcdef"), letters(n, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), pick1("sk_", "ghp_", "AKIA") + letters(n, "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    def iban() -> str:
        body = num(18)
        code = next(c for c in (f"{k:02d}" for k in range(2, 99)) if _mod97("DE" + c + body))
        x = "DE" + code + body
        return x if rng.random() < 0.5 else " ".join(x[k : k + 4] for k in range(0, len(x), 4))

    make = {
        "EMAIL": lambda: pick1(word(), word() + "." + word(), word() + "." + num(2), word() + "_" + num(3), word() + "+" + word(), ".".join(letters(1) for _ in range(int(rng.integers(3, 14)))) + "." + word()) + "@" + pick1(word() + "." + pick1("com", "org", "de", "example"), word() + num(1) + ".example." + pick1("com", "net", "org"), word() + "-" + word() + ".co.uk"),
        "PHONE": phone,
        "IP": lambda: ".".join(str(int(x)) for x in rng.integers(0, 256, 4)),
        "CARD": card,
        "SECRET": secret,
        "SSN": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "IBAN": iban,
    }
    plain = [
        lambda: num(int(rng.integers(1, 8))),
        lambda: f"{num(1)}.{num(1)}.{num(1)}",
        lambda: f"{num(1)}.{num(2)}",
        lambda: f"20{num(2)}-{num(2)}-{num(2)}",
        lambda: f"{num(2)}/{num(2)}/20{num(2)}",
        lambda: f"{num(2)}:{num(2)}",
        lambda: f"{int(rng.integers(256, 999))}.{num(3)}.{num(3)}.{num(3)}",
        lambda: word() + num(int(rng.integers(1, 5))),
        lambda: "@" + word(),
        lambda: word() + "@" + word(),
        lambda: num(int(rng.integers(8, 12))),
        lambda: "v" + num(1) + "." + num(2) + "." + num(1) + "." + num(1),
        lambda: f"{num(1)},{num(3)},{num(3)}",
        lambda: word() + "-" + num(2),
        lambda: "$" + num(3) + "." + num(2),
        lambda: letters(6, "0123456789abcdef"),
        lambda: num(4) + " " + num(4),
        lambda: num(3) + " " + num(2),
        lambda: word() + "." + word() + num(1) + "." + word(),
        lambda: "https://www." + word() + "." + word() + ".com/" + num(3),
    ]
    out: list[tuple[str, str | None]] = []
    for _ in range(int(rng.integers(2, 7))):
        r = rng.random()
        if r < 0.4:
            kind = pick1(*TYPES)
            if kind == "SECRET":
                lead = pick1("token = ", "api_key: ", "password=", "secret ", "key = ", "Bearer ", "", "the ")
                q = pick1('"', "'", "")
                out += [(lead + q, None), (make[kind](), kind), (q, None)]
            else:
                if rng.random() < 0.15:
                    out.append((pick1("(", '"', "<", "[", ":"), None))
                out.append((make[kind](), kind))
            if rng.random() < 0.35:
                out.append((pick1(".", ",", "!!", "###", "$$$", ";", ")", "&&&", "%%%", "***", "!", "?"), None))
        elif r < 0.75:
            out.append((pick1(*plain)(), None))
            if rng.random() < 0.3:
                out.append((pick1(".", ",", "!!", "###", "$$$", ")", "%"), None))
        else:
            out.append((word(), None))
        # numbers that touch would be ambiguous, so words stand between them
        out.append((pick1(" ", " ", "\n") + word() + " ", None))
    return out


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def train(lines: int = 500, epochs: int = 8, seed: int = SEED) -> Model:
    """Weights by feature, one for each type."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(lines):
        tokens, gold = [], set()
        for text, kind in _generate(rng):
            t = _tokens(text)
            if kind:
                gold.add((len(tokens), len(tokens) + len(t), kind))
            tokens += t
        data.append((tokens, gold))
    model: Model = {}
    square: Model = {}
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            _, grads = _gradient(model, *data[k])
            step: Model = {}
            for f, g in grads:
                for name in f:
                    step[name] = step.get(name, 0) + g
            for name, g in step.items():
                g = g - 0.0005 * model.get(name, 0)
                square[name] = square.get(name, np.full(len(TYPES), 0.1)) + g * g
                model[name] = model.get(name, np.zeros(len(TYPES))) + 0.4 * g / np.sqrt(square[name])
    return model


_FITTED: dict[tuple, Model] = {}


def fitted() -> Model:
    if "model" not in _FITTED:
        _FITTED["model"] = train()
    return _FITTED["model"]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*b"0123456789@"]] = True


def regions(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and byte ranges of maximal runs of pieces with triggers, each single blank apart."""
    base = int(offs[0])
    t = b[base : int(offs[-1])]
    rel = offs - base
    hit = np.flatnonzero(_TRIGGER[t])
    z = np.zeros(0, np.int64)
    if not len(hit):
        return z, z, z
    # borders: the byte after each blank, row starts; blanks and row ends
    gap = np.flatnonzero(_SPACE[t])
    starts, stops = np.unique(np.concatenate([gap + 1, rel[:-1]])), np.unique(np.concatenate([gap, rel[1:]]))
    s = np.unique(starts[np.searchsorted(starts, hit, "right") - 1])
    e = stops[np.searchsorted(stops, s, "right")] if len(s) else z
    row = np.searchsorted(rel, s, "right") - 1
    joined = (s[1:] == e[:-1] + 1) & (row[1:] == row[:-1]) & (t[np.minimum(e[:-1], len(t) - 1)] == 32)
    head = np.concatenate([[True], ~joined])
    tail = np.concatenate([~joined, [True]])
    return row[head], s[head] + base, e[tail] + base


def find(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Entities of a text as (begin, end, type) in UTF-8 bytes."""
    raw = text.encode()
    return _find_rows(model, np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64)).get(0, [])


def _find_rows(model: Model, b: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
    out: dict[int, list[tuple[int, int, str]]] = {}
    for lo, hi in slices(offs):
        for row, s, e in zip(*(x.tolist() for x in regions(b, offs[lo : hi + 1]))):
            first = int(offs[lo + row])
            # a cut character at the front of the context decodes to nothing
            before = b[max(first, s - 4 * _CONTEXT) : s].tobytes().decode("utf-8", "ignore")[-_CONTEXT:]
            tokens = _tokens(b[s:e].tobytes().decode("utf-8", "replace"))
            found = decode(model, tokens, before)
            if found:
                at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in tokens])])
                out.setdefault(lo + row, []).extend((s - first + int(at[i]), s - first + int(at[j]), kind) for i, j, kind in found)
    return out


def redact(raw: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    parts, at = [], 0
    for s, e, kind in spans:
        parts += [raw[at:s], f"<{kind}>".encode()]
        at = e
    return b"".join([*parts, raw[at:]])


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS), ("redacted", pa.string())])
_OUT_DDL = "doc_id long, spans array<struct<begin:int,end:int,type:string>>, redacted string"


def _redacted(model: Model, column: pa.Array) -> tuple[pa.Array, dict[int, list[tuple[int, int, str]]]]:
    """The column with entities replaced; nulls stay null."""
    b, offs = buffers(column)
    found = _find_rows(model, b, offs)
    if not found:
        return column, found
    # only changed rows are rebuilt
    keep = np.ones(len(column), bool)
    keep[list(found)] = False
    new = pa.array([redact(b[offs[r] : offs[r + 1]].tobytes(), x).decode("utf-8", "replace") for r, x in sorted(found.items())], column.type)
    where = np.cumsum(~keep) - 1 + len(column)
    take = np.where(keep, np.arange(len(column)), where)
    return pa.concat_arrays([column, new]).take(pa.array(take)), found


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, spans, redacted) of every row: entities as begin, end (in UTF-8 bytes) and type, and the text with <TYPE> for each.

    A null text has null spans and redaction; an empty or clean one no spans and itself. Entities don't overlap; of
    segmentations of equal score the one with fewer entity tokens is taken. Null ids stay null, repeated rows give
    repeated results, other columns are ignored.
    """
    model = model or fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            new, found = _redacted(model, text)
            valid = text.is_valid().to_pylist()
            spans = pa.array([[{"begin": s, "end": e, "type": k} for s, e, k in found.get(r, ())] if valid[r] else None for r in range(len(text))], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, new], schema=_OUT)

    return pick(docs, doc_id="long", text="string").mapInArrow(run, _OUT_DDL)


def redact_documents(docs: DataFrame, model: Model | None = None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with their texts redacted and, if there is such a column, their lengths in characters renewed. No shuffle.

    Null, empty and clean texts stay as they are, repeated rows give repeated results, an empty table stays empty, and other columns, whatever their names, are kept.
    """
    model = model or fitted()
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[at], _ = _redacted(model, cols[at])
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            del cols
            pa.default_memory_pool().release_unused()

    plain = docs.toDF(*[f"_{k}" for k in range(len(docs.columns))])
    inner = T.StructType([T.StructField(f"_{k}", f.dataType, True) for k, f in enumerate(schema.fields)])
    out = plain.mapInArrow(run, inner)
    if length in docs.columns:
        k = docs.columns.index(length)
        out = out.withColumn(f"_{k}", F.length(f"_{at}").cast(schema[k].dataType))
    return out.toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
