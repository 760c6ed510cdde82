"""Personal data by fixed rules and bootstrapped contextual extraction.

Rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers. These are the seeds of a bootstrap: one or
two words before an identifier, one or two behind it, or one on each side are lexical patterns, each for one outer form
(mail, dotted, number, dial, code), so that a pattern speaks only of what looks like its seeds. Identifiers and patterns
are a graph over the whole corpus, kept as a table of edges. Spark scores it in rounds: a pattern's score for a kind is
the lower end of the confidence interval of the part of its different identifiers that are trusted to be of that kind,
so that patterns met seldom, and common words beside all sorts of numbers, stay below; an identifier is trusted as much
as its best pattern. Patterns that end with a high score and enough different seeds find further identifiers that no rule
matched, such as cards whose check digit is wrong and phone numbers without a plus sign: whatever run of digits or token
stands in such a place.

Every rule is linear in the text's length: runs are matched from their first character only.

Defined results: a null or empty text has no spans; spans are half-open ranges of code points, in order of kind and
start; found spans never overlap those of rules; of kinds whose patterns score alike the first listed wins; very long
texts take time in proportion to their length; rows that repeat a doc_id and text get equal results, and a doc_id
with different texts is treated text by text; an empty table gives an empty result; other columns pass through
``redact`` and are ignored elsewhere.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, per_batch, stored, texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Identifiers that no rule need match: runs of digits with usual signs between, and tokens.
_RUN = re.compile(r"\(?[0-9][0-9 ().-]*[0-9]")
_TOKEN = re.compile(r"@?[A-Za-z0-9][A-Za-z0-9._@/:-]*")
_BEFORE = re.compile(r"(?:([^\W\d_]+)\W{1,4})?([^\W\d_]+)\W{0,4}\Z")
_BEHIND = re.compile(r"\W{0,4}([^\W\d_]+)(?:\W{1,4}([^\W\d_]+))?")
#: Characters beside an identifier in which its neighbouring words are looked for.
_REACH = 60
#: Digits that a run, and a token without an at sign, has at least.
_RUN_DIGITS, _TOKEN_DIGITS = 7, 4
#: Digits from which a run of them counts as a number of an account or card.
_NUMBER_DIGITS = 12


def emails(text: str) -> list[tuple[int, int]]:
    """From each at sign outwards: the run of local characters before it, as far as the last match, and a dotted domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > free and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def _passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of all rule matches, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and _passes_luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _context(text: str, start: int, end: int) -> tuple[str, str, str, str]:
    """The word two before, the one before, the one behind and the one after that; empty where there is none."""
    before = _BEFORE.search(text[max(0, start - _REACH) : start])
    behind = _BEHIND.match(text[end : end + _REACH])
    return tuple((x or "").lower() for x in (*(before.groups() if before else ("", "")), *(behind.groups() if behind else ("", ""))))


def form(identifier: str) -> str:
    """The outer form: mail, dotted, number, dial or code."""
    if "@" in identifier:
        return "mail"
    signs = set(identifier) - set("0123456789")
    digits = sum(c.isdigit() for c in identifier)
    if signs == {"."} and identifier.count(".") >= 3:
        return "dotted"
    if signs <= {" ", "-"} and digits >= _NUMBER_DIGITS:
        return "number"
    return "dial" if signs <= set(" ().+-") else "code"


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(kind's number or -1, start, end, identifier, form, two words before, two behind) of all identifiers."""
    taken = sorted((a, b) for _, a, b in spans)
    starts = [a for a, _ in taken]
    longest = max((b - a for a, b in taken), default=0)

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        while i and starts[i - 1] + longest > a:  # spans of two kinds may overlap, so more than one can reach here
            i -= 1
            if taken[i][1] > a:
                return False
        return True

    out = [(k, a, b) for k, a, b in spans]
    runs: list[tuple[int, int]] = []
    for m in _RUN.finditer(text):
        if sum(c.isdigit() for c in m.group()) >= _RUN_DIGITS and free(*m.span()) and not _glued(text, *m.span()):
            runs.append(m.span())
    i = 0
    for m in _TOKEN.finditer(text):
        token = m.group().rstrip("._-/:@")
        a, b = m.start(), m.start() + len(token)
        if not ("@" in token or sum(c.isdigit() for c in token) >= _TOKEN_DIGITS) or not free(a, b):
            continue
        while i < len(runs) and runs[i][1] <= a:
            i += 1
        if i == len(runs) or runs[i][0] >= b:
            out.append((-1, a, b))
    out += [(-1, a, b) for a, b in runs]
    return [(k, a, b, re.sub(r"\s+", " ", text[a:b].lower()), form(text[a:b]), *_context(text, a, b)) for k, a, b in out]


def _glued(text: str, a: int, b: int) -> bool:
    """Whether a run is part of a token with letters."""
    return (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())


def _key() -> Column:
    return F.xxhash64("text")


_CANDIDATE = "array<struct<kind:int,start:long,stop:long,identifier:string,form:string,before2:string,before:string,behind:string,behind2:string>>"


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and all identifiers of every document; texts without digit or at sign stay in the JVM."""
    bound_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), *((c, pa.string()) for c in ("identifier", "form", "before2", "before", "behind", "behind2"))]))
    names = [f.name for f in kind.value_type]

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(names, c)) for c in candidates(t, rule_spans(t))] if t else [] for t in batch["text"].to_pylist()]
        return pa.record_batch([batch["doc_id"], batch["key"], pa.array(found, kind)], names=["doc_id", "key", "found"])

    rows = texts(docs).withColumn("key", _key()).withColumn("text", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).otherwise(F.lit("")))
    return rows.mapInArrow(per_batch(find), f"doc_id long, key long, found {_CANDIDATE}")


def _patterns() -> Column:
    """The patterns of an identifier, by its form: one word or two before, one or two behind, and one on each side."""
    words = {c: F.col(f"x.{c}") for c in ("before2", "before", "behind", "behind2")}

    def of(mark: str, *names: str) -> Column:
        there = F.lit(True)
        for name in names:
            there = there & (words[name] != "")
        return F.when(there, F.concat_ws(" ", F.col("x.form"), F.lit(mark), *(words[n] for n in names)))

    made = F.array(of("<", "before"), of("<", "before2", "before"), of(">", "behind"), of(">", "behind", "behind2"), of("_", "before", "behind"))
    return F.explode(F.array_compact(made))


def bootstrap(found: DataFrame, rounds: int = 3, trust: float = 0.75, seeds: int = 3, deviations: float = 1.645) -> DataFrame:
    """pattern, kind, score of the patterns that end with a score of ``trust`` and at least ``seeds`` different seeds.

    A pattern's score is the lower end of Wilson's interval, ``deviations`` wide, of its trusted part. Edges are
    aggregated before every join, so a pattern or identifier that is everywhere is one row for each of its neighbours.
    """
    single = found.select(F.explode("found").alias("x"))
    edges = single.select(F.xxhash64("x.identifier").alias("identifier"), F.col("x.kind").alias("kind"), _patterns().alias("pattern"))
    edges = stored(edges.groupBy("pattern", "identifier").agg(F.max("kind").alias("kind")), "pattern-edges")
    seeded = edges.groupBy("pattern").agg(F.count("*").alias("total"), F.count_if(F.col("kind") >= 0).alias("known"))
    # a pattern that no seed has, or with nothing to find, plays no part
    totals = seeded.where("known > 0 and total > known").select("pattern", "total")
    able = stored(edges.join(totals, "pattern"), "open-patterns")
    start = able.where("kind >= 0").select("identifier", "kind", F.lit(1.0).alias("trusted")).distinct()
    now = start
    for turn in range(rounds):
        links = able.drop("kind").join(now, "identifier")
        sums = links.groupBy("pattern", "kind", "total").agg(F.sum("trusted").alias("hits"), F.count_if(F.col("trusted") == 1).alias("seeds"))
        n, z2 = F.col("total"), deviations**2
        p = F.col("hits") / n
        low = (p + z2 / (2 * n) - deviations * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
        scored = stored(sums.where(F.col("seeds") >= seeds).withColumn("score", F.round(low, 9)), "pattern-scores")
        if turn < rounds - 1:
            spread = able.where("kind < 0").drop("kind").join(scored.where(F.col("score") >= trust / 2).select("pattern", "kind", "score"), "pattern").groupBy("identifier", "kind").agg(F.max("score").alias("trusted"))
            now = stored(start.unionByName(spread.withColumn("trusted", F.least(F.col("trusted"), F.lit(0.999)))), "identifier-trust")
    good = scored.where(F.col("score") >= trust)
    return good.groupBy("pattern").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))


def personal_spans(docs: DataFrame, **how: float) -> DataFrame:
    """doc_id, key, base and spans (arrays of kind, start, stop in order of kind and start) of every document."""
    found = stored(identifiers(docs), "identifiers")
    patterns = bootstrap(found, **how)
    unknown = found.select("doc_id", "key", F.explode("found").alias("x")).where("x.kind < 0")
    placed = unknown.select("doc_id", "key", "x.start", "x.stop", _patterns().alias("pattern")).join(patterns, "pattern")
    named = placed.groupBy("doc_id", "key", "start", "stop").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    more = named.groupBy("doc_id", "key").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("more"))
    base = F.transform(F.filter("found", lambda x: x["kind"] >= 0), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    rows = found.select("doc_id", "key", base.alias("base"), F.exists("found", lambda x: x["kind"] < 0).alias("open"))
    closed = rows.where("not open").select("doc_id", "key", "base", F.array_sort("base").alias("spans"))
    opened = rows.where("open").join(more.withColumnsRenamed({"doc_id": "id2", "key": "key2"}), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    return closed.unionByName(opened.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:long,stop:long>>")))).alias("spans")))


def written(spans: str) -> Column:
    """Spans as text, kind:start:end joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")


def redact(docs: DataFrame, **how: float) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars, where there is one, follows the text."""
    own, hashed, found = fresh(docs, "id", "key", "spans")
    marked = personal_spans(docs, **how).where("size(spans) > 0").select(F.col("doc_id").alias(own), F.col("key").alias(hashed), F.col("spans").alias(found)).dropDuplicates([own, hashed])
    could = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    schema = docs.schema
    clean = docs.where(~could)
    held = docs.where(could).join(marked, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(hashed)), "left")
    # from the last span to the first, so that earlier positions hold
    backwards = F.reverse(F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.col("text").alias("text"), F.lit(1 << 40).cast("long").alias("edge"))

    def cut(state: Column, x: Column) -> Column:
        stop = F.least(x["stop"], state["edge"])
        text = F.concat(F.substr(state["text"], F.lit(1), x["start"].cast("int")), F.get(kinds, x["kind"]), F.substr(state["text"], stop.cast("int") + 1))
        return F.when(x["start"] < state["edge"], F.struct(text.alias("text"), x["start"].alias("edge"))).otherwise(state)

    changed = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.aggregate(backwards, begin, cut, lambda s: s["text"]))
    out = clean.unionByName(held.withColumn("text", changed).select(docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return out.select(docs.columns)
