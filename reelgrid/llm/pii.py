"""Personal data: exact patterns, and a linear-chain CRF over word shapes for forms that the patterns miss.

The CRF is trained from a small labelled table and decodes chains of words around every word that
holds a digit or an at-sign or spells "at" or "dot": every sound span holds a digit, an at-sign or an "at".
Chains are cut where plain words stand in between and grow while their end is tagged as personal data.
What it finds is added if it overlaps no pattern span and is sound.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import plainly, slices
from .crf import Crf, trained
from .spans import Span, free_of, tabled

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

MAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits, as every match ends at the end of one.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NAME_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in NAME_LETTERS:
            start -= 1
        end = MAIL_END.match(text, at) if start < at else None
        if end:
            out.append(("email", start, end.end()))
            free = end.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """Pattern matches, leftmost and non-overlapping per kind, without those that fail their check."""
    out = _emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# The labelled table: personal data in braces with its kind; all else is none.
LABELLED = """
please call {phone:(212) 555-0199} before noon
tel {phone:212-555-0147} or fax
reach us under {phone:030 5550 1234} at night
phone: {phone:(030) 555-01234}, ask for details
my number is {phone:0170 5550123} today
appelez le {phone:01 55 50 12 34} demain
ring {phone:555-0143} now
cell {phone:415.555.0132} works too
the office ({phone:212-555-0188}) is closed
they answer {phone:(171) 555-2028} and the rest
then {phone:(416) 555-0000} on the other
and {phone:646-555-9001} with that
mail {email:john.doe [at] example.org} please
send it to {email:sales@localhost} now
or {email:max @ example.de} instead
ask {email:team42 at mail5 dot example dot com} there
write to {email:jane at example dot com} please
contact {email:anna at mail dot example dot org} today
ask {email:max (at) example (dot) de} first
the address {email:lee [at] example [dot] net} is hers
or ask {email:kim dot lee at example dot com} for more
reach {email:bob.smith at example.org} there
{email:sales AT example DOT com} answers
{email:jane at example dot com}
her friend {email:mary at sample dot net} wrote back soon
some people {email:tom at post dot org} never answer
old river {email:sue dot may at mail dot example dot co dot uk} green stone
we met at the old bridge and went home
look at this and that
he was at home. She is at work
a red dot at the top of the map
they arrived at dawn to eat
at the end of the day at last
the shop at example street is closed
people at large. Then we left at once.
look at dot two and at the other dot
it was {email:root@mailhost} that sent this
paid with {card:4111.1111.1111.1111} yesterday
card {card:5500/0000/0000/0004} was charged
the number {card:4222222222222} expired
use {card:3782.822463.10005} here
visa {card:4012_8888_8888_1881} and a name
server {ip:2001:db8:0:0:0:0:2:1} is down
host {ip:fe80::1ff:fe23:4567:890a} answered
from {ip:192.0.2.17:8080} to there
ping {ip:198.51.100.7/24} first
node {ip:10[.]0[.]0[.]7} was seen
in 1999 there were 12 of them
chapter 4, page 217 and line 33
it costs 19.99 or 1,250 in all
the version 2.4.1 came on 2021-03-05 at 10:30
about 3.14159 times 100 is 314
id 20240817123456 of row 88213
numbers 1 2 3 4 5 6 7 8 9
sector 7G and room B12 on floor 3
a total of 1234567 items in 45 rows
see 12-34 and 56/78 for 90%
token 9f86d081884c7d65 and 0x7ffe
ratio 16:9 at 1080p with 60fps
he said @home and @work are tags
the year 1984 and the 24th of May
1,000,000 people in 50 states
score 3-2 after 90 minutes
between 10.5 and 11.25 on 3 days
order 00012345 shipped in 2 boxes
part 555 of 1000 and 0199 is next
from 8 to 12 or 13 to 17
phone books of 1980 have 500 pages
call 3 of 10 took 25 seconds
at 5 o'clock we saw 20 birds
mail came 2 times in 2005
a card with 4 numbers and 16 dots
server 7 has 128 cores and 512 gigabytes
"""

WORD = re.compile(r"\S+")
CUE = frozenset("at dot call tel phone fax cell ring number mail contact write card visa server host ip ping from to on in of and the".split())


INNER_DOT = re.compile(r"[^\W\d]\.[^\W\d]")


def shape(word: str, most: int = 14) -> str:
    return "".join("d" if c.isdigit() else "a" if c.isalpha() else c for c in word[:most])


def squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", shape(word, 40))


def word_features(words: list[str], i: int) -> list[str]:
    """Word-shape features of a word and of its neighbours. Plain words are told by a short list only."""
    word = words[i]
    core = word.strip(".,;:!?()[]{}\"'")
    digits = sum(c.isdigit() for c in core)
    out = ["1", f"q={squeezed(core)}", f"n={min(digits, 20)}", f"a={core[:1] if not core[:1].isalnum() else shape(core[:1])}"]
    out += [f"s={shape(core)}"] if digits else [f"w={core.lower() if core.lower() in CUE else '-'}"]
    if "@" in core:
        out.append("@")
    if word[:1] in "([" or word[-1:] in ")]":
        out.append(f"b={word[:1] if word[:1] in '([' else ''}{word[-1:] if word[-1:] in ')]' else ''}")
    for name, j in (("p", i - 1), ("f", i + 1)):
        near = words[j].strip(".,;:!?\"'") if 0 <= j < len(words) else "|"
        out.append(f"{name}={squeezed(near) if any(c.isdigit() or c in '@([' for c in near) else near.lower() if near.lower() in CUE or near == '|' else '-'}")
    # Spelled addresses: what stands up to two words away, brackets or not.
    for j in (-2, -1, 1, 2):
        if 0 <= i + j < len(words):
            near = words[i + j].strip(".,;:!?()[]{}<>\"'").lower()
            if near in ("at", "dot"):
                out.append(f"{j}={near}")
            elif INNER_DOT.search(near):
                out.append(f"{j}=.")
    return out


def labelled_rows() -> list[tuple[str, list[Span]]]:
    """The table as (text, spans)."""
    rows = []
    for line in LABELLED.strip().splitlines():
        text, spans = "", []
        for i, part in enumerate(re.split(r"\{(\w+:[^}]*)\}", line)):
            if i % 2:
                kind, value = part.split(":", 1)
                spans.append((kind, len(text), len(text) + len(value)))
                part = value
            text += part
        rows.append((text, spans))
    return rows


def fitted(rows: list[tuple[str, list[Span]]]) -> Crf:
    chains, tagged = [], []
    for text, spans in rows:
        words = list(WORD.finditer(text))
        own = []
        for m in words:
            kind = next(((k, a) for k, a, b in spans if m.start() < b and m.end() > a), None)
            own.append("O" if kind is None else f"{'B' if m.start() <= kind[1] else 'I'}-{kind[0]}")
        plain = [m[0] for m in words]
        chains.append([word_features(plain, i) for i in range(len(plain))])
        tagged.append(own)
    return trained(chains, tagged, TAGS)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return fitted(labelled_rows())


# Without a digit, an at-sign or the word "at" no span is sound; "dot" joins the parts of long addresses.
ODD = re.compile(r"[0-9@]|\b(?:at|dot)\b", re.IGNORECASE)
REACH = 3  # words on either side of an odd one that belong to its chain, unless tags reach its end


def ranges_of(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of the words of each chain: odd words and their neighbours."""
    return joined_ranges([(i - REACH, i + REACH + 1) for i, (a, b) in enumerate(words) if ODD.search(text, a, b)], len(words))


def joined_ranges(ranges: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The ranges cut to 0 and most; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(a, 0), min(b, most)) for a, b in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def sound(kind: str, value: str) -> bool:
    digits = "".join(DIGIT.findall(value))
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", value)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", value)
    if kind == "email":
        return "@" in value and len(value) > 5
    return len(digits) >= 2 and bool(re.search(r"[.:]", value))


# Names joined by dots, and the same behind a spelled at. Every name is consumed once, so the search is linear.
NAMES = r"[\w%+-]+(?:(?:\.|\s+dot\s+|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*)[\w%+-]+)*+"
SPELLED = re.compile(rf"({NAMES})(?:(\s+at\s+|\s*[\[({{<]\s*at\s*[\])}}>]\s*)(?=({NAMES})))?", re.IGNORECASE)
DOMAIN = re.compile(r"\.|\bdot\b", re.IGNORECASE)


def spelled(text: str, a: int, b: int) -> list[Span]:
    """Addresses with a spelled at. After a bare "at" the domain has a dot, or some part a digit."""
    return [
        ("email", m.start(), m.end(3)) for m in SPELLED.finditer(text, a, b)
        if m[2] and (m[2].strip().lower() != "at" or DOMAIN.search(m[3]) or DIGIT.search(m[1] + m[3])) and m.end(3) - m.start() > 5
    ]


EDGE = ".,;:!?\"'“”«»"


def added_spans(texts: list[str], model: Crf) -> list[list[Span]]:
    words = [[m.span() for m in WORD.finditer(t)] if ODD.search(t) else [] for t in texts]
    ranges = [ranges_of(t, own) for t, own in zip(texts, words)]
    tagged: list[dict[tuple[int, int], list[str]]] = [{} for _ in texts]
    while places := [(row, r) for row, own in enumerate(ranges) for r in own if r not in tagged[row]]:
        chains = []
        for row, (a, b) in places:
            plain = [texts[row][x:y] for x, y in words[row][a:b]]
            chains.append([word_features(plain, i) for i in range(len(plain))])
        for (row, r), tags in zip(places, model.decode(chains)):
            tagged[row][r] = tags
        for row in {row for row, _ in places}:
            # What is tagged up to an end of its chain may go on behind it: the chain is decoded with as many words more.
            wider = [(a - (b - a) * (tagged[row][a, b][0] != "O"), b + (b - a) * (tagged[row][a, b][-1] != "O")) for a, b in ranges[row]]
            ranges[row] = joined_ranges(wider, len(words[row]))
    return [[s for a, b in own for s in spans_of(t, w[a:b], tags[a, b])] for t, w, own, tags in zip(texts, words, ranges, tagged)]


def spans_of(text: str, chain: list[tuple[int, int]], tags: list[str]) -> list[Span]:
    out: list[Span] = []
    i = 0
    while i < len(tags):
        kind, j = tags[i][2:], i + 1
        if kind:
            while j < len(tags) and tags[j] == f"I-{kind}":
                j += 1
            a, b = chain[i][0], chain[j - 1][1]
            while a < b and text[a] in EDGE:
                a += 1
            while a < b and text[b - 1] in EDGE:
                b -= 1
            if kind == "email" and "@" not in text[a:b]:
                out += spelled(text, a, b)
            elif a < b and sound(kind, text[a:b]):
                out.append((kind, a, b))
        i = j
    return out


def find_private(df: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, span_list`` of every row.

    Counts and digest are those of the pattern spans; ``spans`` and ``span_list`` hold the CRF's too.
    ``model``: as ``fitted`` gives it (default: from the table above). A null or empty text has no spans.
    Null ids and repeated rows come back as they are; other columns are left out; an empty table gives
    an empty one. Whole texts of any length are searched.
    """
    crf = model or default_model()
    return tabled(df, lambda: finder(crf), KINDS, KINDS, id_col, text_col)


def finder(crf: Crf) -> Callable[[list[str]], list[tuple[list[Span], list[Span]]]]:
    def find(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        base = [base_spans(t) for t in texts]
        return [(own, free_of(more, own)) for own, more in zip(base, added_spans(texts, crf))]

    return find


def masked(df: DataFrame, model: Crf | None = None, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All columns of ``df`` with every span of the text replaced by its kind in angle brackets.

    Spans that overlap are replaced as one, named after the first. ``count_col`` gets the new number of
    code points. Null texts stay null.
    """
    crf = model or default_model()
    rows, back = plainly(df, **({"text": text_col} | ({"count": count_col} if count_col else {})))

    def cover(text: str, spans: list[Span]) -> str:
        out, at, reach = [], 0, -1
        for kind, a, b in sorted(spans, key=lambda s: s[1]):
            if a >= reach:
                out += [text[at:a], f"<{kind.upper()}>"]
            reach = max(reach, b)
            at = reach
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(crf)
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            found = find([t or "" for t in texts])
            new = [None if t is None else cover(t, [*own, *more]) for t, (own, more) in zip(texts, found)]
            columns = {n: part.column(n) for n in part.schema.names} | {"text": pa.array(new, pa.string())}
            if count_col:
                columns["count"] = pa.array([old if t is None else len(t) for t, old in zip(new, part.column("count").to_pylist())], part.schema.field("count").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return back(rows.mapInArrow(run, rows.schema))
