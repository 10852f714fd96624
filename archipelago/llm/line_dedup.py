"""Fuzzy line dedup (operator 1).

Lines that differ in a few characters are one component, of which the first
line of the corpus stays.

1. Equal lines (trimmed, lower case) are one class, keyed by 64 bits; two
   different lines share a key with a chance of 2 ** -64.
2. Shingles of ``SHINGLE`` UTF-16 units are hashed ``STEP`` to a row, in generated
   code, and aggregated to ``BANDS * ROWS`` minima of each class.  Every minimum
   is over all shingles of the line.
3. Banding: ``ROWS`` minima are a bucket.  In a bucket each class is paired with
   one, its hub: candidates grow with the bucket's size, not its square.  The hub
   is the class that shares most buckets with others, counted by rows: in a group
   of near copies that is the one nearest to all, which links them at once.
4. Candidates go on if their signatures (a byte of each minimum) agree in
   ``AGREE`` places or more, and are confirmed by the Jaccard similarity of
   their full shingle sets.
5. Where a bucket's other members are not in one component yet, those of
   different components are compared with each other the same way, but for
   pairs that their sketches rule out, which are never rows.  A sketch has the
   parities of a line's distinct shingles by ``64 * PARITIES`` buckets: where two
   differ is a shingle that only one line has, so no link is ever ruled out.
6. Distributed union-find (:func:`archipelago.llm.components.union_find`).

Recall: two lines of similarity 0.8 share no bucket, or fail at the signatures,
with a probability of about 0.002.

All of it is DataFrame functions.

Defined results.  Blank lines are no lines: they are never removed and never
counted.  Lines shorter than a shingle are one shingle.  A null or empty text
has no lines and is returned with none.  Rows are told apart by position, so
repeated rows and repeated or null ids lose their repeated lines like any
other; a row's id only orders lines (null ids first).  Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipelago.llm.components import union_find
from archipelago.llm.storage import drop, store

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 12, 4
#: Bytes of the signatures that must agree at least.  Of 48 minima at similarity
#: 0.8, fewer do with a probability of 2e-4.
AGREE = 28
#: Signature bytes in a long; six, so that sums of them cannot overflow.
LANES = 6
#: Longs of a sketch.
PARITIES = 16
#: Shingles in a row: an aggregate's buffer is touched once for so many.
STEP = 8

_BLANK = r"[^\x20\x09-\x0D]"
_LOW = int("7f" * LANES, 16)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _shifts(k: int) -> tuple[int, int]:
    """Where the minimum ``k`` looks at the two hashes of a shingle."""
    return 5 * k % 61, 7 * (k + 3) % 59


def _minima(classes: DataFrame) -> DataFrame:
    """``id, m0, m1, ...`` of every class.

    The values of a minimum are exclusive ors of two hashes of the shingle,
    shifted by different steps, so each orders the shingles by other bits.
    """
    units = classes.select("id", F.encode("line", "UTF-16BE").alias("units"))
    units = units.withColumn("last", F.greatest(F.lit(1), F.octet_length("units") - F.lit(2 * SHINGLE - 1)))
    each = units.select("id", "units", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * STEP))).alias("at"))
    # past the end the last shingle comes again, which changes no minimum
    spots = [F.least(F.col("at") + F.lit(2 * j), F.col("last")) for j in range(STEP)]
    ones = each.select("id", *[F.xxhash64(F.substring("units", at, F.lit(2 * SHINGLE))).alias(f"one{j}") for j, at in enumerate(spots)])
    hashed = ones.select("*", *[F.xxhash64(f"one{j}").alias(f"two{j}") for j in range(STEP)])
    values = []
    for k in range(BANDS * ROWS):
        a, b = _shifts(k)
        values.append(F.min(F.least(*[F.shiftleft(f"one{j}", a).bitwiseXOR(F.shiftleft(f"two{j}", b)) for j in range(STEP)])).alias(f"m{k}"))
    return hashed.groupBy("id").agg(*values)


def _keys() -> Column:
    """A key for each band."""
    return F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{ROWS * b + k}") for k in range(ROWS)]) for b in range(BANDS)])


def _signature() -> list[Column]:
    """A byte of each minimum, ``LANES`` to a long."""
    out = []
    for at in range(0, BANDS * ROWS, LANES):
        word = F.lit(0).cast("long")
        for k in range(LANES):
            word = word.bitwiseOR(F.shiftleft(F.xxhash64(f"m{at + k}").bitwiseAND(F.lit(255)), 8 * k))
        out.append(word.alias(f"s{at // LANES}"))
    return out


_WORDS = [f"s{k}" for k in range(BANDS * ROWS // LANES)]
_SKETCH = [f"p{k}" for k in range(PARITIES)]


def _agreeing(one: str, two: str) -> Column:
    """In how many bytes two signatures agree."""
    out = F.lit(BANDS * ROWS)
    for w in _WORDS:
        x = F.col(f"{one}.{w}").bitwiseXOR(F.col(f"{two}.{w}"))
        # the high bit of every byte that differs
        out = out - F.bit_count(((x.bitwiseAND(F.lit(_LOW)) + F.lit(_LOW)).bitwiseOR(x)).bitwiseAND(F.lit(int("80" * LANES, 16))))
    return out


def _set(line: str) -> Column:
    """Hashes of the distinct shingles."""

    def hashed(units: Column) -> Column:
        last = F.greatest(F.lit(1), F.octet_length(units) - F.lit(2 * SHINGLE - 1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last, F.lit(2)), lambda at: F.xxhash64(F.substring(units, at, F.lit(2 * SHINGLE)))))

    return _let(F.encode(F.col(line), "UTF-16BE"), hashed)


def _near(percent: int) -> Column:
    """Whether the sets of ``la`` and ``lb`` are similar enough; sizes come first."""

    def linked(sets: Column) -> Column:
        n, m = F.size(sets["a"]), F.size(sets["b"])
        may = F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
        enough = _let(F.size(F.array_intersect(sets["a"], sets["b"])), lambda both: F.lit(100) * both >= F.lit(percent) * (n + m - both))
        return F.when(may, enough).otherwise(F.lit(False))

    return _let(F.struct(_set("la").alias("a"), _set("lb").alias("b")), linked)


def _sketched(texts: DataFrame) -> DataFrame:
    """``id, n, p0, ...``: the number of distinct shingles and their parities."""
    sets = texts.select("id", _set("line").alias("set")).withColumn("n", F.size("set"))
    each = sets.select("id", "n", "set", F.explode(F.sequence(F.lit(0), F.col("n") - F.lit(1), F.lit(STEP))).alias("at"))
    parts = each.select("id", "n", *[F.coalesce(F.get("set", F.col("at") + F.lit(j)), F.lit(0)).alias(f"h{j}") for j in range(STEP)], *[(F.col("at") + F.lit(j) < F.col("n")).alias(f"in{j}") for j in range(STEP)])
    bits = parts.select("id", "n", *[F.expr(f"if(in{j}, shiftleft(1L, cast(h{j} & 63 as int)), 0L)").alias(f"bit{j}") for j in range(STEP)], *[F.expr(f"shiftright(h{j}, 6) & {PARITIES - 1}").alias(f"at{j}") for j in range(STEP)])
    parities = [F.bit_xor(F.expr(" ^ ".join(f"if(at{j} = {k}, bit{j}, 0L)" for j in range(STEP)))).alias(p) for k, p in enumerate(_SKETCH)]
    return bits.groupBy("id").agg(F.max("n").alias("n"), *parities)


def _possible(one: str, two: str, percent: int) -> Column:
    """Whether sizes and sketches leave room for the similarity: sets that have it
    differ in ``(100 - percent) / (100 + percent)`` of their sizes' sum at most."""
    n, m = F.col(f"{one}.n"), F.col(f"{two}.n")
    differ = sum((F.bit_count(F.col(f"{one}.{p}").bitwiseXOR(F.col(f"{two}.{p}"))) for p in _SKETCH), F.lit(0))
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)) & (F.lit(100 + percent) * differ <= F.lit(100 - percent) * (n + m))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are near."""
    met = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")).hint("shuffle_merge"), "a")
    met = met.join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")).hint("shuffle_merge"), "b")
    return store(met.select("a", "b", _near(percent).alias("near")).where("near").select("a", "b"), "line-links")


def _signed(signs: DataFrame, id_: str, *more: str) -> DataFrame:
    return signs.select(F.col("id").alias(id_), F.struct(*_WORDS, *more).alias(f"s{id_}")).hint("shuffle_merge")


def _links(classes: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The links that make the components, and more of the same.

    ``lines(id, line)`` has every class; those that share a bucket are fetched.
    ``classes`` is deleted.
    """
    keys = classes.select("id", F.explode("keys").alias("key"))
    shared = store(keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "line-keys")
    fame = shared.groupBy("id").agg(F.sum("n").alias("fame"))
    famed = shared.select("key", "id").join(fame.hint("shuffle_merge"), "id")
    # of equal fame the least id: ~id is the greatest then
    hubs = famed.groupBy("key").agg(F.max(F.struct("fame", F.expr("~id").alias("id"))).alias("x")).select("key", F.expr("~x.id").alias("hub"))
    placed = store(shared.select("key", "id").join(hubs.hint("shuffle_merge"), "key").where("id <> hub"), "line-buckets")
    # the keys go: they are more than half of the classes' bytes
    signs = store(classes.select("id", *_WORDS), "line-signatures")
    drop(classes)
    drop(shared)
    met = placed.select(F.explode(F.array("hub", "id")).alias("id")).distinct()
    texts = store(lines.join(met.hint("shuffle_merge"), "id", "left_semi").groupBy("id").agg(F.first("line").alias("line")), "line-texts")
    first = placed.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    first = first.join(_signed(signs, "a"), "a").join(_signed(signs, "b"), "b").where(_agreeing("sa", "sb") >= AGREE).select("a", "b")
    first = store(first, "line-pairs")
    links = _confirmed(first, texts, percent)
    comp = store(union_find(links), "line-components")
    # the hub has met all; are the others of its bucket one component?
    around = placed.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    open_ = around.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    spread = store(around.join(open_, "key"), "line-spread")
    drop(placed)
    drop(comp)
    asked = texts.join(spread.select("id").distinct().hint("shuffle_merge"), "id", "left_semi")
    signed = signs.join(_sketched(asked).hint("shuffle_merge"), "id")
    rows = store(spread.join(_signed(signed, "id", "n", *_SKETCH), "id"), "line-open")
    for table in (signs, spread):
        drop(table)
    main = rows.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "c")).alias("x")).select("key", F.col("x.c").alias("c0"))
    rows = rows.join(main, "key").withColumnRenamed("sid", "s")
    one = rows.where("c <> c0").select("key", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("s").alias("sa"))
    two = rows.select("key", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("c0"), F.col("s").alias("sb"))
    # the comparison is the join's own condition: only pairs that may be links leave it
    apart = (F.col("ca") != F.col("cb")) & ((F.col("a") < F.col("b")) | (F.col("cb") == F.col("c0")))
    met = one.join(two.hint("shuffle_merge"), (one["key"] == two["key"]) & apart & (_agreeing("sa", "sb") >= AGREE) & _possible("sa", "sb", percent))
    more = store(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    if more.head(1):
        links = links.unionByName(_confirmed(more, texts, percent))
    for table in (texts, first, rows, more):
        drop(table)
    return links


def _judged(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The stored lines ``row, doc_id, line_no, id, g``, ``g`` being their
    component, with one row without a line for each text that has none, and
    ``g, head``: the first line of each component of two lines or more.

    Rows are numbered once, when the lines are stored; the texts of the classes
    come from another reading, which needs no row numbers.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = rows.select("row", "doc_id", F.explode_outer(_numbered(F.col("text"))).alias("x"))
    marked = store(lines.select("row", "doc_id", F.col("x.no").alias("line_no"), F.xxhash64("x.line").alias("id")), "lines")
    each = docs.select(F.explode(_numbered(text)).alias("x")).select(F.xxhash64("x.line").alias("id"), F.col("x.line").alias("line"))
    one = each.groupBy("id").agg(F.first("line").alias("line"))
    classes = store(_minima(one).select("id", _keys().alias("keys"), *_signature()), "line-classes")
    comp = store(union_find(_links(classes, each, percent)), "line-components")
    grouped = marked.join(comp, "id", "left").withColumn("g", F.coalesce("component", "id")).drop("component")
    order = F.struct("doc_id", "row", "line_no")
    heads = grouped.where("line_no IS NOT NULL").groupBy("g").agg(F.min(order).alias("head"), F.count("*").alias("n")).where("n > 1").select("g", "head")
    return grouped, store(heads, "line-heads")


def _numbered(text: Column) -> Column:
    """``no, line`` of every line that is not blank, as lines are compared."""
    lines = F.transform(F.split(text, "\n"), lambda x, no: F.struct(no.alias("no"), F.lower(F.trim(x)).alias("line")))
    return F.filter(lines, lambda x: x["line"].rlike(_BLANK))


def _is_head() -> Column:
    return F.struct("doc_id", "row", "line_no").eqNullSafe(F.col("head"))


def duplicate_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every line that is not blank: ``row, doc_id, line_no, id, component,
    kept``; ``kept`` marks the first line of each component."""
    grouped, heads = _judged(docs, percent)
    found = grouped.where("line_no IS NOT NULL").join(heads, "g", "left")
    return found.select("row", "doc_id", "line_no", "id", F.col("g").alias("component"), (F.col("head").isNull() | _is_head()).alias("kept"))


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_kept`` and the numbers,
    from 0, of the ``removed_lines``, comma-joined."""
    grouped, heads = _judged(docs, percent)
    counts = grouped.groupBy("row", "doc_id").agg(F.count("line_no").alias("n_lines"))
    gone = grouped.where("line_no IS NOT NULL").join(heads, "g").where(~_is_head()).groupBy("row").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    return counts.join(gone, "row", "left").select(
        "doc_id", "n_lines", (F.col("n_lines") - F.size(removed)).alias("n_kept"), F.array_join(removed.cast("array<string>"), ",").alias("removed_lines")
    )


def without_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text`` of every row without its removed lines.

    The rows are numbered in a stored table, in the order of ``doc_id``, and
    judged by that number, so verdicts and texts agree however often ``docs``
    is read and in whatever order.
    """
    rows = store(docs.select("doc_id", "text").orderBy("doc_id").select(F.monotonically_increasing_id().alias("at"), "doc_id", "text"), "rows")
    lines = duplicate_lines(rows.select(F.col("at").alias("doc_id"), "text"), percent)
    gone = lines.where("NOT kept").groupBy(F.col("doc_id").alias("at")).agg(F.collect_set("line_no").alias("gone"))
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return rows.join(gone, "at", "left").select("doc_id", F.array_join(left, "\n").alias("text"))
