"""Personal data: base patterns seed a bootstrapped contextual extraction.

Base matches are the seeds. The words beside an identifier, its lexical patterns, and the identifiers are the two
sides of a graph; an edge is an occurrence of an identifier next to a pattern. Spark scores the graph in rounds: a
pattern's confidence for a kind is the share of its distinct identifiers that are believed to be of the kind (one
unbelieved identifier is added to each pattern), and an unseen identifier is believed by the noisy-or of its
patterns. Patterns that reach ``CONFIDENT`` with ``SUPPORT`` believed identifiers then mark unseen identifiers:
strings of a kind's loose shape (a card number that fails its check digit, a phone number without a plus sign),
anywhere in the text, that the base patterns don't take. Base matches always stay; words alone never make an
identifier.

A pattern is the next word (a run of letters and digits) on one side, whole and however far, up to the identifier
beyond it: nothing is cut, and each stretch between two identifiers is read twice at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm._shared import fresh, remove, row_key, sliced, table, written

KINDS = ("email", "ip", "card", "phone")
CONFIDENT, SUPPORT, ROUNDS = 0.8, 5, 3
BROADCAST_ROWS = 200_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches begin and end with whole runs of digits, so a begin within a run is never the leftmost.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MAYBE = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\W_]+")
_EDGES = "\"'`.,;!?()[]{}<>|*#$%&:="
#: Loose shapes: an at sign between what may be of an address; numbers between what is neither letter nor digit.
_APART = "\\s@\"'`<>,;:()\\[\\]{}=&?#|"
_MAIL = re.compile(f"(?<![^{_APART}])[^{_APART}]++@[^{_APART}]+")
_NUMBERS = (
    (1, re.compile(r"(?<![0-9A-Za-z])[0-9]{1,4}(?:[.:-][0-9]{1,4}){3}(?![0-9A-Za-z])")),
    (2, re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .-]?[0-9]){11,19}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])\(?[0-9](?:(?:[().-]|\)? |\)-)?[0-9]){6,14}(?![0-9A-Za-z])")),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign: the local part back to what is taken or to the last sign, then the domain."""
    taken = 0
    at = text.find("@")
    while at >= 0:
        begin = taken + len(text[taken:at].rstrip(_LOCAL))
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            taken = m.end()
        else:
            taken = at + 1
        at = text.find("@", taken)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base match, by kind and start."""
    if not _MAYBE.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _context(word: str) -> str:
    """A word as a pattern: folded, digits alike."""
    return re.sub("[0-9]+", "0", word.lower())


def _before(text: str, low: int, at: int) -> str:
    """The last word of text[low:at], looked for in ever longer stretches."""
    reach = 64
    while True:
        begin = max(low, at - reach)
        last = None
        for last in _WORD.finditer(text, begin, at):  # noqa: B007
            pass
        if begin == low or (last and last.start() > begin):
            return last[0] if last else ""
        reach *= 8


def _candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kinds as bits) of strings of loose shape, none overlapping another, the first and longest of them."""
    found: dict[tuple[int, int], int] = {}
    if "@" in text:
        for m in _MAIL.finditer(text):
            cut = m[0].lstrip(_EDGES)
            begin, cut = m.end() - len(cut), cut.rstrip(_EDGES)
            sides = cut.partition("@")
            if sides[0] and sides[2]:
                found[begin, begin + len(cut)] = 1
    for kind, shape in _NUMBERS:
        for m in shape.finditer(text):
            found[m.span()] = found.get(m.span(), 0) | 1 << kind
    out: list[tuple[int, int, int]] = []
    for begin, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or begin >= out[-1][1]:
            out.append((begin, end, found[begin, end]))
    return out


@dataclass
class Found:
    """Base spans and occurrences of many texts, column by column."""

    spans: list[list] = field(default_factory=lambda: [[], [], []])
    seen: list[list] = field(default_factory=lambda: [[] for _ in range(7)])
    span_ends: list[int] = field(default_factory=lambda: [0])
    seen_ends: list[int] = field(default_factory=lambda: [0])

    def read(self, text: str | None) -> None:
        """The base spans, and every occurrence with its context: seeds (their kind) and candidates (kinds they may be of)."""
        text = text or ""
        if _MAYBE.search(text):
            self._read(text)
        self.span_ends.append(len(self.spans[0]))
        self.seen_ends.append(len(self.seen[0]))

    def _read(self, text: str) -> None:
        spans = base_spans(text)
        for column, values in zip(self.spans, zip(*spans, strict=True), strict=False):
            column += values
        every = [(a, b, k, 1 << k) for k, a, b in spans]
        taken, at, reach = sorted((a, b) for _, a, b in spans), 0, 0
        for a, b, may in _candidates(text):
            while at < len(taken) and taken[at][0] < b:
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= a:
                every.append((a, b, -1, may))
        every.sort()
        # Overlapping identifiers stand in one place and share its context.
        i, low = 0, 0
        while i < len(every):
            begin, end, j = every[i][0], every[i][1], i + 1
            while j < len(every) and every[j][0] < end:
                end = max(end, every[j][1])
                j += 1
            left = _context(_before(text, low, begin))
            m = _WORD.search(text, end, every[j][0] if j < len(every) else len(text))
            right = _context(m[0]) if m else ""
            for a, b, kind, may in every[i:j]:
                for column, value in zip(self.seen, (text[a:b], kind, may, a, b, left, right), strict=True):
                    column.append(value)
            i, low = j, end

    def arrays(self) -> list[pa.Array]:
        lists = []
        for ends, columns, kind in ((self.span_ends, self.spans, _SPAN), (self.seen_ends, self.seen, _SEEN)):
            rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.fields, strict=True)], fields=list(kind.fields))
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows))
        return lists


_SPAN = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
_SEEN = pa.struct([("instance", pa.string()), ("seed", pa.int32()), ("may", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("right", pa.string())])
_SPANS_SQL = "array<struct<k:int,s:int,e:int>>"
_SEEN_SQL = "array<struct<instance:string,seed:int,may:int,start:int,end:int,left:string,right:string>>"


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, pk (of id and text), base spans and occurrences of every row of docs(doc_id, text), as a scratch table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            found, texts = Found(), batch.column(2)
            for i in range(len(texts)):
                found.read(texts[i].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found.arrays()], ["doc_id", "pk", "base", "seen"])

    slim = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("pk"), "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return written(slim.mapInArrow(run, f"doc_id {kind}, pk string, base {_SPANS_SQL}, seen {_SEEN_SQL}"), "pii")


def patterns(found: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence, believed) of the patterns that reach the limits."""
    seen = found.select(F.explode("seen").alias("o")).select("o.*")
    sides = F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right")))
    edges = written(seen.select(sides.alias("pattern"), F.lower("instance").alias("instance"), "seed", "may").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.bit_or("may").alias("may")).where(F.length("pattern") > 2), "pii_edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.where("seed >= 0").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("belief")).distinct()
    belief, last = seeds, None
    for turn in range(rounds):
        sums = edges.select("pattern", "instance").join(belief, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("s"), F.sum((F.col("belief") > 0.5).cast("long")).alias("believed"))
        rated = written(sums.join(sizes, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + 1)).alias("confidence"), "believed"), "pii_patterns")
        if last is not None:
            remove(last)
        last = rated
        if turn + 1 < rounds:
            doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
            unseen = edges.where("seed < 0").join(rated.where((F.col("confidence") >= 0.5) & (F.col("believed") >= support)), "pattern").where("shiftright(may, kind) & 1 = 1")
            grown = unseen.groupBy("instance", "kind").agg((1 - doubt).alias("belief"))
            belief = seeds.unionByName(grown.join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti"))
    return last.where((F.col("confidence") >= confident) & (F.col("believed") >= support))


def discovered(found: DataFrame, known: DataFrame) -> DataFrame:
    """pk and the spans that confident patterns add, for the rows that have some. Repeated rows count once."""
    seen = found.select("pk", F.explode(F.filter("seen", lambda o: o["seed"] < 0)).alias("o")).select("pk", "o.*")
    sides = F.explode(F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right")))
    hits = seen.withColumn("pattern", sides).join(known, "pattern").where("shiftright(may, kind) & 1 = 1")
    one = hits.groupBy("pk", "start", "end").agg(F.max_by("kind", F.struct(F.col("confidence"), -F.col("kind"))).alias("k"))
    return one.groupBy("pk").agg(F.collect_list(F.struct("k", F.col("start").alias("s"), F.col("end").alias("e"))).alias("more"))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind number, start, end) of every row of docs(doc_id, text).

    Null texts are empty. Repeated rows each get a row. Other columns are not read; an empty table has no rows.
    """
    found = occurrences(docs)
    more = written(discovered(found, patterns(found)), "pii_found")
    joined = found.select("doc_id", "pk", "base").join(more, "pk", "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", F.coalesce("more", F.array().cast(_SPANS_SQL))))
    return joined.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(every).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...) with every span of their texts replaced by its kind in angle brackets.

    n_chars follows where a text changes, if it is there. Null and empty texts stay as they are, repeated rows each
    stay, other columns of any name pass unread, and an empty table stays empty.
    """
    found = occurrences(docs)
    more = written(discovered(found, patterns(found)), "pii_found")
    remove(found)
    few = F.broadcast(more) if more.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else more
    names = docs.columns
    place = names.index("text")
    key, extra_name = fresh(names, "pk", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, place):
            texts, extra = batch.column(place), batch.column(len(names))
            out, sizes = [], {}
            for i in range(len(texts)):
                text = texts[i].as_py()
                new = text if text is None else replaced(text, [*base_spans(text), *((x["k"], x["s"], x["e"]) for x in extra[i].as_py() or ())])
                if new != text:
                    sizes[i] = len(new)
                out.append(new)
            columns = [batch.column(i) for i in range(len(names))]
            columns[place] = pa.array(out, batch.schema.field(place).type)
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([sizes.get(j, n) for j, n in enumerate(columns[i].to_pylist())], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(few.select(F.col("pk").alias(key), F.col("more").alias(extra_name)), key, "left").drop(key)
    return keyed.select(*names, extra_name).mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text without its spans; overlapping ones are one, named by the first."""
    if not spans:
        return text
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.element_at(names, s["k"] + 1), F.lit(":"), s["s"], F.lit(":"), s["e"])), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *(count(i) for i in range(4)), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
