"""Secret scans: fixed patterns, and the values of credential contexts whose
cheapest guess is dear enough.

The guess cost of a value is the least log10 number of guesses over all ways to
cut it into words, dates, repeats, keyboard walks, sequences and brute-force
spans, by dynamic programming over end positions (the idea of Wheeler's zxcvbn,
2016): the costs of the parts add up, and a part more costs a factor for its
order. The whole value is one programme, whatever its length: words and dates are
bounded, a repeat or sequence goes as far as it holds, and walks are carried as a
state, so the work is linear in the value. Spans are code points, end exclusive.

Words are ranked: a short list that attackers try first, then the words of a
vocabulary file in the order of its ids, which is about that of their frequency.

One pass over the rows, no shuffle; a text is scanned whole.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed, with the
# group whose length decides and the least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
KINDS = ("assign", "access", "hex", "guess")

#: Contexts that announce a credential; the value is group 2 or, in quotes, group 3.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth)"""
    r"""["']?\x20{0,3}(?::=|=>|[:=])\x20{0,3}(?:["']([^"'\n]{4,})["']|([^\s"',;<>]{4,}))""",
    re.I | re.A,
)
#: log10 guesses from which a value counts as a secret.
LEAST_COST = 8.0
#: log10 costs: of a part after another, of a walk's first key and each further one,
#: of a word not in lower case; a word in changed letters has its rank this often.
JOINT, WALK, STEP, CASED, CHANGED = 0.3, math.log10(47), 0.45, 0.4, 8

# Words that attackers try first, commonest first.
WORDS = (
    "password", "qwerty", "dragon", "letmein", "monkey", "master", "shadow", "login", "admin", "welcome",
    "sunshine", "princess", "football", "baseball", "secret", "superman", "batman", "trustno", "hello", "freedom",
    "whatever", "michael", "jordan", "harley", "ranger", "hunter", "buster", "soccer", "hockey", "killer",
    "george", "charlie", "andrew", "thomas", "robert", "daniel", "summer", "winter", "spring", "autumn",
    "love", "test", "user", "root", "guest", "default", "changeme", "pass", "temp", "demo",
    "example", "sample", "token", "server", "access", "money", "computer", "internet", "flower", "orange",
    "cookie", "banana", "pepper", "ginger", "tigger", "cheese", "chicken", "silver", "golden", "purple",
    "none", "null", "true", "false", "your", "here", "value", "string", "enter", "required",
)
#: Words of fewer or more characters are not looked up.
SHORTEST, LONGEST = 3, 24
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def _neighbours() -> dict[str, str]:
    """Keys beside, above and below a key on staggered rows."""
    at = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    places = {p: c for c, p in at.items()}
    near = ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0))
    # The digits' row begins one key further left than the letters' rows.
    shift = lambda r, i: (r, i - (r == 0))
    by_place = {shift(*p): c for p, c in places.items()}
    return {c: "".join(by_place.get((shift(r, i)[0] + dr, shift(r, i)[1] + di), "") for dr, di in near) for c, (r, i) in at.items()}


NEAR = _neighbours()


@functools.lru_cache(maxsize=4)
def ranks(vocabulary: str | None = None) -> Mapping[str, int]:
    """Words to their ranks, from 1: WORDS, then the whole words of a byte-level
    vocabulary file (pieces of letters after a space) by their ids."""
    words = dict.fromkeys(WORDS)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as file:
            pieces = json.load(file)["model"]["vocab"]
        for piece in sorted(pieces, key=pieces.__getitem__):
            word = piece[1:].lower()
            if piece[0] == "\u0120" and word.isascii() and word.isalpha() and SHORTEST <= len(word) <= LONGEST:
                words.setdefault(word)
    return {w: i for i, w in enumerate(words, 1)}


def _alphabet(text: str) -> int:
    """The size of the alphabet that a brute-force attacker needs."""
    size = 0
    for test, n in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        size += n * any(map(test, text))
    return size + 33 * (not text.isalnum()) or 10


def lowered(value: str) -> str:
    """Lower case, character by character: one that has no single lower case stays,
    so that places in the result are places in the value."""
    if value.isascii():
        return value.lower()
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def word_cost(value: str, low: str, plain: str, i: int, j: int, rank: Mapping[str, int]) -> float | None:
    """What value[i:j] costs as a word, as it stands or with changed letters."""
    at = rank.get(low[i:j])
    if at is None:
        at = rank.get(plain[i:j])
        if at is None:
            return None
        at *= CHANGED
    return math.log10(at + 1) + CASED * (value[i:j] != low[i:j])


def date_cost(length: int) -> float:
    return math.log10(365 * 120) if length > 4 else math.log10(120)


def repeat_cost(unit: str, times: int) -> float:
    return math.log10(_alphabet(unit)) * len(unit) + math.log10(times)


def sequence_cost(length: int) -> float:
    return math.log10(62) + math.log10(length)


def reaches(links: list[bool]) -> list[int]:
    """For each place how many links in a row begin there."""
    out, run = [0] * len(links), 0
    for k in range(len(links) - 1, -1, -1):
        run = run + 1 if links[k] else 0
        out[k] = run
    return out


def guess_cost(value: str, rank: Mapping[str, int] | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 number of guesses for a value and the cut that has it.

    Parts are: a word of the list; a date; a unit of one to four characters
    repeated from its place as often as it goes, of three characters or more in
    all; three or more keys that neighbour each other in turn; characters in rising
    or falling order from their place as far as they go, three or more; and any
    brute-force span. A part after another adds JOINT.
    """
    n = len(value)
    if not n:
        return 0.0, []
    rank = ranks() if rank is None else rank
    low = lowered(value)
    plain = low.translate(LEET)
    unit = math.log10(_alphabet(value))
    near = [False, *(low[k] in NEAR.get(low[k - 1], "") for k in range(1, n))]
    same = [reaches([low[k] == low[k + u] for k in range(n - u)]) for u in range(1, 5)]
    steps = [reaches([ord(low[k + 1]) - ord(low[k]) == by and low[k + 1].isalnum() for k in range(n - 1)]) for by in (1, -1)]
    # The least cost of a cut of value[:k] that ends in a brute-force span, in a walk
    # that may go on, in any part but brute force; and where the last of it came from.
    brute, walk, part = [math.inf] * (n + 1), [math.inf] * (n + 1), [math.inf] * (n + 1)
    begun, walked, came = [0] * (n + 1), [0] * (n + 1), [(0, "")] * (n + 1)
    part[0] = 0.0
    for i in range(n + 1):
        if i >= 3 and near[i - 1] and near[i - 2]:
            cost = min(part[i - 3], brute[i - 3]) + (JOINT if i > 3 else 0.0) + WALK + 2 * STEP
            walk[i], walked[i] = min((cost, i - 3), (walk[i - 1] + STEP, walked[i - 1]))
            if walk[i] < part[i] - 1e-12:
                part[i], came[i] = walk[i], (walked[i], "walk")
        if i == n:
            break
        joint = JOINT if i else 0.0
        brute[i + 1], begun[i + 1] = min((brute[i], begun[i]), (part[i] + joint, i))
        brute[i + 1] += unit
        base = min(part[i], brute[i]) + joint

        def offer(j: int, kind: str, cost: float, i: int = i, base: float = base) -> None:
            if base + cost < part[j] - 1e-12:
                part[j], came[j] = base + cost, (i, kind)

        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            cost = word_cost(value, low, plain, i, j, rank)
            if cost is not None:
                offer(j, "word", cost)
        if value[i].isdigit() and (m := DATE.match(value, i)):
            offer(m.end(), "date", date_cost(m.end() - i))
        for u, run in enumerate(same, 1):
            times = run[i] // u + 1 if i < len(run) else 1
            if times >= 2 and times * u >= 3:
                offer(i + times * u, "repeat", repeat_cost(value[i : i + u], times))
        for run in steps:
            if i < len(run) and run[i] >= 2:
                offer(i + run[i] + 1, "sequence", sequence_cost(run[i] + 1))
    cuts: list[tuple[int, int, str]] = []
    j = n
    while j:
        i, kind = (begun[j], "brute") if brute[j] < part[j] else came[j]
        cuts.append((i, j, kind))
        j = i
    return min(part[n], brute[n]), cuts[::-1]


def costed(text: str, rank: Mapping[str, int] | None = None, least: float = LEAST_COST) -> list[tuple[int, int, str, float | None]]:
    """All spans (start, end, kind, cost) of a text, by start, then kind as listed."""
    found: list[tuple[int, int, str, float | None]] = [
        (m.start(), m.end(), kind, None) for kind, pattern, group, short in BASE for m in pattern.finditer(text) if len(m[group]) >= short
    ]
    for m in CONTEXT.finditer(text):
        i, j = m.span(2) if m[2] is not None else m.span(3)
        cost = guess_cost(text[i:j], rank)[0]
        if cost >= least:
            found.append((i, j, "guess", cost))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(text: str, rank: Mapping[str, int] | None = None) -> list[tuple[int, int, str]]:
    return [(i, j, k) for i, j, k, _ in costed(text, rank)]


def secret_spans(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COST) -> DataFrame:
    """Every secret of every document.

    Returns one row per input row: id and spans, an array of (start, end, kind,
    cost), cost being the log10 guess cost of a "guess" and null else. `vocabulary`
    is the file whose words are ranked after the short list; a value counts from a
    cost of `least`. A null or empty text has no spans; repeated rows have equal
    ones. Values of any length are costed whole. Other columns are not read.
    """
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("cost", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks(vocabulary)
        for b in batches:
            out = []
            for t in b.column(1):
                out.append([{"start": i, "end": j, "kind": k, "cost": c} for i, j, k, c in costed(t.as_py() or "", rank, least)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=pa.list_(span))], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<start:int,end:int,kind:string,cost:double>>")
