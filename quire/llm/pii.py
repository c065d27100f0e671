"""Personal data by fixed forms, and by bootstrapped contextual extraction; Spark functions only.

Base. Four forms (``KINDS``), leftmost and not overlapping within a kind, then checked: parts of
an address up to 255, the check digit of a card, the digits of a phone number. The patterns are
written so that no text makes them slow: a run of characters is entered at its start or where
the last match ended, and repeated groups do not backtrack. Places, neighbours and overlaps come from
running sums and maxima over a text's matches, so time grows with the text, whatever it holds.

Method. Base spans are the seeds. A mention is a seed, or an identifier-like token (``MIN_DIGITS``
digits or an at sign) or spaced digit groups (in the form of a card or phone number, unchecked and
with or without the plus) that no seed overlaps. A pattern is a neighbouring word (left, right, or both)
with the shape of the mention, which a leading plus does not change. Mentions with equal
text are one instance. Patterns and instances form a graph, scored in ``ROUNDS``
rounds: a pattern's confidence in a kind is the sum of its instances' scores over their number
plus one, if at least ``SUPPORT`` instances carry the kind; an instance that is no seed gets one
minus the product of (1 - confidence) over its patterns of at least ``PATTERN_CONFIDENCE``. What
reaches ``ACCEPT`` is a new span of its best kind (ties: as listed), wherever it is mentioned.
A text that is a seed elsewhere is accepted outright.

All of it is joins and sums over the corpus: common patterns and instances combine
before they are shuffled, and nothing is gathered per pattern.

Edge cases. A null text counts as empty: no spans. Documents with equal id and text share
their spans; rows of equal id and other text keep theirs. Long texts are read whole.
Columns pass through; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS = 4
ROUNDS = 3
SUPPORT = 3
PATTERN_CONFIDENCE = 0.8
ACCEPT = 0.9
BROADCAST_SPANS = 100_000  # of at most 100 bytes each
_STEP = 256  # values that are added up together
_MANY = 64  # spans of a text that is redacted by its characters
_FAR = 1 << 30

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What a text must hold for the kind to occur in it; cheaper than the pattern.
_HINTS = {
    "email": lambda text: text.contains("@"),
    "ip": lambda text: text.rlike(r"[0-9]\.[0-9]"),
    "card": lambda text: text.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": lambda text: text.rlike(r"\+[0-9]"),
}
_WHITE = r"[\x20\x09-\x0D]"
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_GROUPS = (PATTERNS["card"], r"\+?[0-9][ ().0-9-]+[0-9]")
_CORE = r"[0-9A-Za-z@+](?:.*[0-9A-Za-z])?"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; in array functions it would be for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def prefixes(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's whole numbers, what it and all before it combine to (sums, maxima).

    An array grows by copying, so runs of ``_STEP`` values are done apart and joined by what each comes to.
    """
    empty = F.array().cast("array<int>")

    def grown(done: Column, value: Column, kept: Column) -> Column:
        return F.struct(value.cast("int").alias("last"), F.concat(done["all"], F.array(kept.cast("int"))).alias("all"))

    def run(part: Column) -> Column:
        first = F.struct(F.lit(None).cast("int").alias("last"), empty.alias("all"))

        def step(done: Column, value: Column) -> Column:
            now = F.coalesce(combine(done["last"], value), value)
            return grown(done, now, now)

        return F.aggregate(part, first, step)

    def joined(runs: Column) -> Column:
        first = F.struct(F.lit(None).cast("int").alias("last"), empty.alias("all"))

        def step(done: Column, part: Column) -> Column:
            return grown(done, F.coalesce(combine(done["last"], part["last"]), part["last"]), done["last"])

        before = F.aggregate(runs, first, step, lambda done: done["all"])
        return F.flatten(
            F.zip_with(runs, before, lambda r, at: F.transform(r["all"], lambda v: F.coalesce(combine(at, v), v)))
        )

    def whole(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / F.lit(_STEP)).cast("int") - 1, F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(v, c * _STEP + 1, F.lit(_STEP)))
        return let(F.transform(parts, run), joined)

    return let(values, whole)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _largest(a: Column, b: Column) -> Column:
    return F.when(a >= b, a).when(b > a, b)  # null if either is


_MATCHES = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """Array of (start, end, value, left, right) of all matches, in code points.

    With ``context``, ``left`` and ``right`` are the words beside a match that white space sets apart from it; else null.
    """
    runs = lambda piece: F.regexp_count(piece, F.lit(_WHITE + "+"))

    def placed(found: Column, gaps: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.array(F.char_length(g), F.char_length(v)))

        def spans(at: Column, words: Column | None, seen: Column | None) -> Column:
            def one(value: Column, i: Column) -> Column:
                none = F.lit(None).cast("string")
                left = right = none
                if words is not None:
                    # White space before a match tells how many words are before it.
                    left = F.when(F.get(gaps, i).rlike(_WHITE + r"\z"), F.get(words, F.get(seen, i * 2) - 1))
                    right = F.when(F.get(gaps, i + 1).rlike(r"\A" + _WHITE), F.get(words, F.get(seen, i * 2 + 1) + 1))
                return F.struct(
                    F.get(at, i * 2).alias("start"),
                    F.get(at, i * 2 + 1).alias("end"),
                    value.alias("value"),
                    F.lower(left).alias("left"),
                    F.lower(right).alias("right"),
                )

            return F.transform(found, one)

        at = prefixes(F.flatten(pairs), _sum)
        if not context:
            return let(at, lambda p: spans(p, None, None))
        white = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.array(runs(g), runs(v)))
        seen = prefixes(F.flatten(white), _sum)
        words = F.split(text, _WHITE + "+", -1)
        return let(at, lambda p: let(words, lambda w: let(seen, lambda n: spans(p, w, n))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The text is cut at the matches only where there are any.
    return let(
        found,
        lambda f: F.when(F.size(f) > 0, let(F.split(text, pattern, -1), lambda g: placed(f, g))).otherwise(
            F.array().cast(_MATCHES)
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    last_first = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(last_first, i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, digit).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(last_first)), F.lit(0), add)
    return total % 10 == 0


def _small_part(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.char_length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, value: Column) -> Column:
    count = F.char_length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_part)
    if kind == "card":
        return F.when(count.between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return count.between(10, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,rank:int,end:int,value:string,left:string,right:string>>"


def _span(m: Column, rank: int) -> Column:
    fields = [m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")]
    return F.struct(*fields, *[m[c].alias(c) for c in ("value", "left", "right")])


def base_spans(text: Column, context: bool = False) -> Column:
    """All base spans as (start, rank of the kind, end, value, left, right), in that order."""

    def of_kind(rank: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind], context), lambda m: _valid(kind, m["value"]))
        ranked = F.transform(found, lambda m: _span(m, rank))
        return F.when(_HINTS[kind](text), ranked).otherwise(F.array().cast(_SPANS))

    by_kind = [of_kind(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*by_kind))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _tokens(text: Column) -> Column:
    """Identifier-like tokens without the punctuation around them."""

    def trimmed(m: Column) -> Column:
        core = F.regexp_extract(m["value"], _CORE, 0)
        skipped = F.instr(m["value"], core) - 1
        start = m["start"] + skipped
        end = start + F.char_length(core)
        return F.struct(
            start.cast("int").alias("start"),
            F.lit(-1).alias("rank"),
            end.cast("int").alias("end"),
            core.alias("value"),
            F.when(skipped == 0, m["left"]).alias("left"),
            F.when(end == m["end"], m["right"]).alias("right"),
        )

    def likely(m: Column) -> Column:
        return (F.char_length(_digits(m["value"])) >= MIN_DIGITS) | m["value"].contains("@")

    return F.filter(F.transform(matches(text, _TOKEN, context=True), trimmed), likely)


def _groups(text: Column) -> Column:
    """Digit groups with blanks between them, in the forms that base spans have."""

    def spaced(m: Column) -> Column:
        return m["value"].contains(" ") & (F.char_length(_digits(m["value"])) >= MIN_DIGITS)

    def of_form(pattern: str) -> Column:
        return F.transform(F.filter(matches(text, pattern, context=True), spaced), lambda m: _span(m, -1))

    each = F.array_sort(F.concat(*map(of_form, _GROUPS)))
    once = let(each, lambda e: F.filter(e, lambda m, i: (i == 0) | ~m.eqNullSafe(F.get(e, i - 1))))
    return F.when(text.rlike("[0-9][).-]* "), once).otherwise(F.array().cast(_SPANS))


def _free(tokens: Column, base: Column) -> Column:
    """Tokens that no base span overlaps, by one sweep over both in order."""

    def swept(both: Column) -> Column:
        # At one place a base span, of higher rank, comes first.
        ends = prefixes(F.transform(both, lambda m: F.when(m["rank"] >= 0, m["end"]).otherwise(0)), _largest)
        starts = F.transform(F.reverse(both), lambda m: F.when(m["rank"] >= 0, -m["start"]).otherwise(-_FAR))
        following = F.reverse(prefixes(starts, _largest))

        def alone(m: Column, i: Column, e: Column, n: Column) -> Column:
            return (m["rank"] < 0) & (F.get(e, i) <= m["start"]) & (-F.get(n, i) >= m["end"])

        return let(ends, lambda e: let(following, lambda n: F.filter(both, lambda m, i: alone(m, i, e, n))))

    def order(a: Column, b: Column) -> Column:
        key = lambda m: F.struct(m["start"], -m["rank"], m["end"], m["value"])
        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    both = F.array_sort(F.concat(tokens, base), order)
    return F.when(F.size(base) == 0, tokens).otherwise(let(both, swept))


def mentions(found: DataFrame) -> DataFrame:
    """One row per mention: _row, start, end, rank (-1: no seed), instance, patterns.

    ``found`` has _row, text and _base.
    """
    near = found.where(F.col("text").rlike("[0-9@]"))
    tokens = F.concat(_tokens(F.col("text")), _groups(F.col("text")))
    each = near.withColumn("_token", tokens).select(
        "_row", F.explode(F.concat("_base", _free(F.col("_token"), F.col("_base")))).alias("m")
    )
    plain = F.regexp_replace(F.lower("m.value"), r"^\+", "")
    shape = F.regexp_replace(plain, r"(?<![0-9])[0-9]{1,3}(?![0-9])", "d")
    shape = F.regexp_replace(F.regexp_replace(shape, "[0-9]", "9"), r"\p{L}+", "a")
    each = each.select(
        "_row", "m.start", "m.end", "m.rank", F.lower("m.value").alias("instance"),
        F.coalesce("m.left", F.lit("")).alias("l"), F.coalesce("m.right", F.lit("")).alias("r"), shape.alias("s"),
    )
    made = F.array(
        F.when(F.col("l") != "", F.concat_ws("\t", F.lit("l"), "l", "s")),
        F.when(F.col("r") != "", F.concat_ws("\t", F.lit("r"), "r", "s")),
        F.when((F.col("l") != "") & (F.col("r") != ""), F.concat_ws("\t", F.lit("b"), "l", "r", "s")),
    )
    return each.select("_row", "start", "end", "rank", "instance", F.array_compact(made).alias("patterns"))


def bootstrap(mentioned: DataFrame) -> DataFrame:
    """instance, rank: the kind of each instance that the graph accepts or that is a seed."""
    edges = materialize(
        mentioned.select("instance", F.explode("patterns").alias("pattern")).distinct(), "pattern-edges"
    )
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    seeds = materialize(
        mentioned.where("rank >= 0").groupBy("instance").agg(F.min("rank").alias("rank")), "pattern-seeds"
    )
    known = seeds.select("instance", "rank", F.lit(1.0).alias("score"))
    scores = known
    for _ in range(ROUNDS):
        carried = edges.join(scores, "instance").groupBy("pattern", "rank")
        sums = carried.agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("support"))
        confident = sums.where(F.col("support") >= SUPPORT).join(sizes, "pattern")
        confident = confident.withColumn("confidence", F.col("total") / (F.col("size") + 1))
        confident = confident.where(F.col("confidence") >= PATTERN_CONFIDENCE)
        reached = edges.join(confident, "pattern").groupBy("instance", "rank")
        reached = reached.agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        fresh = reached.join(seeds.select("instance"), "instance", "left_anti")
        scores = materialize(known.unionByName(fresh), "pattern-scores")
    accepted = scores.where(F.col("score") >= ACCEPT).groupBy("instance")
    best = F.max(F.struct("score", (-F.col("rank")).alias("last")))
    return accepted.agg((-best["last"]).cast("int").alias("rank"))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, rank, end), in that order.

    ``rank`` is the place of the kind in ``KINDS``.
    """
    kept = docs.drop("base", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = lambda spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    )
    row = F.struct("doc_id", F.xxhash64(text), F.char_length(text))
    found = kept.select(row.alias("_row"), text.alias("text"), base_spans(text, context=True).alias("_base"))
    mentioned = materialize(mentions(found), "mentions")
    new = mentioned.where("rank < 0").drop("rank").join(bootstrap(mentioned), "instance")
    # A collected list holds the spans of one text; rows of equal id and text give the same ones.
    added = new.groupBy("_row").agg(F.collect_set(F.struct("start", "rank", "end")).alias("_added"))
    based = kept.select("*", row.alias("_row"), plain(base_spans(text)).alias("base"))
    added = materialize(added.withColumnRenamed("_row", "_found"), "added-spans")
    size = added.agg(F.count(F.lit(1)), F.sum(F.size("_added"))).collect()[0]
    # Few texts gain spans: these go to the texts, unless they are many.
    if size[0] + (size[1] or 0) <= BROADCAST_SPANS:
        added = F.broadcast(added)
    joined = based.join(added, F.col("_row").eqNullSafe(F.col("_found")), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return joined.select(
        *kept.columns, "base", F.array_sort(F.concat("base", F.coalesce("_added", none))).alias("spans")
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind and spans of each document."""
    spans = find(docs.select("doc_id", "text"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return spans.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span's text replaced by its kind in brackets.

    Where spans overlap, the part that an earlier span has not covered goes with it.
    """
    names = F.array(*[F.lit(f"<{k}>".upper()) for k in KINDS])
    found = find(docs)

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        gap = F.substring(F.col("text"), done["at"] + 1, span["start"] - done["at"])
        added = F.when(fresh, F.concat(done["out"], gap, names[span["rank"]])).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), added.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.char_length("text")))
    few = F.aggregate("spans", start, step, rest)

    def by_characters(chars: Column, ends: Column) -> Column:
        """The same for many spans: what is copied is cut from the characters."""

        def piece(first: Column, stop: Column) -> Column:
            return F.array_join(F.slice(chars, first + 1, F.greatest(stop - first, F.lit(0))), "")

        def hidden(span: Column, i: Column) -> Column:
            at = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            fresh = span["start"] >= at
            return F.when(fresh, F.concat(piece(at, span["start"]), names[span["rank"]])).otherwise("")

        return F.concat(F.array_join(F.transform("spans", hidden), ""), piece(F.array_max(ends), F.size(chars)))

    reached = prefixes(F.transform("spans", lambda span: span["end"]), _largest)
    many = let(F.split("text", ""), lambda chars: let(reached, lambda ends: by_characters(chars, ends)))
    hidden_text = F.when(F.size("spans") > _MANY, many).otherwise(few)
    text = F.when(F.size("spans") > 0, hidden_text).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
