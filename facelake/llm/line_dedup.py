"""Removal of lines that an earlier document or line has already, exactly or within a few edits.

Equal lines are found by a 128-bit hash. Lines within `max_edits` edits are found by a
segment-partition join: cut into max_edits + 1 even segments, a line keeps at least one of them
through so few edits, shifted by no more than the edits around it. Each distinct line indexes its own
segments by its length, and probes, for each length it could have come from, the substrings that can
be a segment there. Pairs that meet are verified by a banded bit-parallel edit distance.

A segment that many distinct lines share, as those of a template with numbers do, is not met pair by pair. Lines with such a
segment first look for an earlier one that is the same but for a character left out of either: two such lines lie within
two edits, so the least place among the lines with a variant tells, and no pair is made. Most template lines are settled by that. For
the lines that are left, a shared segment is split by the residual text around it: the residuals lie within the edits
as well, so they share a segment in turn, and so on until few lines share what has been cut out.

A line goes if any earlier line, by doc_id and place, equals it or lies within the edits; of repeated
lines the first stays, and of near ones the earlier. Lines below `min_chars` and everything else of a
text stay as they are. Built-in column expressions only; texts move only for lines that met another.

A line takes part in the near join once, where it stands first, so that no line's copies gather in one task.

Defined results: a null text is empty; lines are compared without leading and trailing blanks; rows
that repeat both doc_id and text count as one document; rows without doc_id come before all others;
texts and lines of any length are compared whole; an empty table gives an empty result. Columns of the
input that are called n_lines or n_removed give way to the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facelake.llm.common import stored, text_column

#: Width of the bit vectors; the band of 2 * max_edits + 1 must fit.
WIDTH = 32
FULL = (1 << WIDTH) - 1
#: A table of row keys and line numbers with no more rows than this (16 MB) is broadcast.
SMALL_ROWS = 500_000
#: A key with more lines than this is split by what is left of the lines.
SHARED_LINES = 50
#: Times that this is done at most; each takes a third off the residual.
LEVELS = 8


def shifts(delta: int, i: int, max_edits: int) -> range:
    """How far segment i of a line can lie from its place in a line that is delta longer."""
    rest = max_edits - i
    return range(max(-i, delta - rest), min(i, delta + rest) + 1)


def cuts(lines: DataFrame, max_edits: int) -> DataFrame:
    """(id, key, own, rest): index keys (own) and probe keys of each of lines (id, salt, own, line), and the text around them.

    The ways to cut a line are rows of a constant, so that one short expression makes all keys. Lines that are no index lines
    (own) give probe keys only.
    """
    parts = max_edits + 1
    ways = [(d, i, shift, d == shift == 0) for d in range(parts) for i in range(parts) for shift in shifts(d, i, max_edits)]
    names = ("delta", "part", "shift", "straight")
    way = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, w, strict=True)]) for w in ways])
    cut = lines.select("id", "salt", "own", "line", F.length("line").alias("n"), F.explode(way).alias("w")).select("id", "salt", "own", "line", "n", "w.*")
    cut = cut.withColumn("whole", F.col("n") - F.col("delta")).where(F.col("whole") >= parts)
    first = F.call_function("div", F.col("whole") * F.col("part"), F.lit(parts)).cast("int")
    end = F.call_function("div", F.col("whole") * (F.col("part") + 1), F.lit(parts)).cast("int")
    cut = cut.withColumns({"at": first + F.col("shift"), "size": end - first})
    cut = cut.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))  # outside the line there is nothing to probe
    key = F.xxhash64("salt", "whole", "part", F.substring("line", F.col("at") + 1, F.col("size")))
    rest = F.concat(F.substring("line", F.lit(1), F.col("at")), F.substring("line", F.col("at") + F.col("size") + 1, F.col("n")))
    return cut.select("id", key.alias("key"), (F.col("own") & F.col("straight")).alias("own"), rest.alias("rest"))


def keys(lines: DataFrame, max_edits: int) -> DataFrame:
    """(id, key, own) of each of lines (id, line)."""
    return cuts(lines.select("id", F.lit(0).cast("long").alias("salt"), F.lit(True).alias("own"), "line"), max_edits).drop("rest")


def within_edits(longer: Column, shorter: Column, max_edits: int) -> Column:
    """Whether two texts, the first no shorter, lie within max_edits edits.

    One step for each character of the shorter text moves a band of 2 * max_edits + 1 rows down the
    longer one; bits of vp and vn say where the distance grows or falls from row to row.
    """
    k = max_edits
    split = F.struct(F.split(longer, "").alias("a"), F.split(shorter, "").alias("b"))
    distance = F.get(F.transform(F.array(split), lambda z: _banded(z["a"], z["b"], k)), F.lit(0))
    n_a, n_b = F.length(longer), F.length(shorter)
    return F.when(n_a - n_b > k, False).when(n_b <= k, F.levenshtein(longer, shorter) <= k).otherwise(distance <= k)


def _banded(a: Column, b: Column, k: int) -> Column:
    """The edit distance of two arrays of characters, len(a) - k <= len(b) <= len(a), right up to k."""
    n_a, n_b = F.size(a), F.size(b)

    def long(value: int) -> Column:
        return F.lit(value).cast("long")

    def invert(x: Column) -> Column:
        return x.bitwiseXOR(long(FULL))

    def equal_bits(i: Column) -> Column:
        bits = long(0)
        for offset in range(-k, k + 1):
            same = F.get(a, i + offset) == F.get(b, i)
            bits = bits + F.when(F.coalesce(same, F.lit(False)), long(1 << (WIDTH - 1 - k + offset))).otherwise(long(0))
        return bits

    zero = F.struct(
        long((FULL << (WIDTH - k - 1)) & FULL).alias("vp"), long(0).alias("vn"), F.lit(k).alias("d"), F.lit(0).alias("i")
    )
    turn = n_a - k  # from here on the last row of the band is the last of the longer text

    def step(s: Column, x: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        carried = (x.bitwiseAND(vp) + vp).bitwiseAND(long(FULL)).bitwiseXOR(vp)
        d0 = carried.bitwiseOR(x).bitwiseOR(vn)

        def rest(d0: Column) -> Column:
            hp, hn = vn.bitwiseOR(invert(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            down = F.shiftrightunsigned(d0, 1)
            last = F.call_function("shiftright", long(1 << (WIDTH - 2)), s["i"] - turn)
            aslant = s["d"] + F.when(d0.bitwiseAND(long(1 << (WIDTH - 1))) == 0, 1).otherwise(0)
            along = s["d"] + F.when(hp.bitwiseAND(last) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(last) != 0, 1).otherwise(0)
            return F.struct(
                hn.bitwiseOR(invert(down.bitwiseOR(hp))).alias("vp"),
                down.bitwiseAND(hp).alias("vn"),
                F.when(s["i"] < turn, aslant).otherwise(along).alias("d"),
                (s["i"] + 1).alias("i"),
            )

        return F.get(F.transform(F.array(d0), rest), F.lit(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n_b - 1), equal_bits), zero, step, lambda s: s["d"])


def _join_rows(left: DataFrame, right: DataFrame, on: str, how: str, rows: int) -> DataFrame:
    """left with the rows of right, which is broadcast only if it is known to be small."""
    return left.join(F.broadcast(right) if rows <= SMALL_ROWS else right, on, how)


def _kept_lines(lines: Column) -> Column:
    """Array of struct(line_no, line) of a text's lines but those of the array of places `lines`, which may be null."""
    parts = F.split("text", "\n", -1)
    places = F.sequence(F.lit(0), F.size(parts) - 1)
    kept = F.when(lines.isNull(), places).otherwise(F.array_except(places, lines))
    both = F.struct(parts.alias("parts"), kept.alias("kept"))
    picked = F.transform(F.array(both), lambda z: F.transform(z["kept"], lambda i: F.struct(i.alias("line_no"), F.get(z["parts"], i).alias("line"))))
    return F.get(picked, F.lit(0))


def near_lines(lines: DataFrame, firsts: DataFrame, rows: DataFrame, max_edits: int) -> DataFrame:
    """(row, line_no) of the first occurrences of lines (id, line) that lie within the edits of an earlier line."""
    # the last bit of a line's number gives way to the role of the key
    keyed = (
        keys(lines, max_edits)
        .select("key", F.col("id").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("own").cast("long")).alias("line"))
        .repartition("key")
    )
    number = F.col("line").bitwiseAND(F.lit(-2))
    # most keys belong to one line; those of several are told by fixed-size aggregates over the same dealing
    # (one that no line has as an index key leads to no pair)
    index = F.max(F.col("line").bitwiseAND(F.lit(1))).alias("index")
    shared = keyed.groupBy("key").agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count("*").alias("n"), index).where("low <> high and index = 1")
    kept = keyed.join(shared.select("key", "n").hint("shuffle_hash"), "key").distinct()
    kept = stored(kept.select("key", "n", number.alias("short_id"), (F.col("line") != number).alias("own")), "line-keys")
    ids = kept.select("short_id").distinct()
    n_ids = ids.count()
    numbered = firsts.withColumn("short_id", F.col("id").bitwiseAND(F.lit(-2)))
    place = _join_rows(numbered, ids, "short_id", "left_semi", n_ids).select("short_id", "doc", "row", "line_no")
    wanted = stored(place.groupBy("row").agg(F.collect_list(F.struct("short_id", "line_no", "doc")).alias("wanted")), "line-places")
    texts = stored(_wanted_lines(_join_rows(rows, wanted, "row", "inner", n_ids)), "line-texts")
    return _near_pairs(kept, texts, max_edits).select("later.row", "later.line_no").distinct()


def _wanted_lines(rows: DataFrame) -> DataFrame:
    """(short_id, at, line, size, chars, grams) of the wanted lines of rows (row, text, wanted)."""
    both = F.struct(F.split("text", "\n", -1).alias("parts"), F.col("wanted").alias("wanted"))
    picked = F.transform(
        F.array(both),
        lambda z: F.transform(
            z["wanted"],
            lambda w: F.struct(w["short_id"].alias("short_id"), w["doc"].alias("doc"), w["line_no"].alias("line_no"), F.get(z["parts"], w["line_no"]).alias("line")),
        ),
    )
    lines = rows.select("row", F.explode(F.get(picked, F.lit(0))).alias("w"))
    lines = lines.select("w.short_id", F.struct("w.doc", "row", "w.line_no").alias("at"), F.trim("w.line").alias("line"))
    return lines.dropDuplicates(["short_id", "at"]).select("*", F.length("line").alias("size"), *_signatures(F.col("line")))


def _signatures(line: Column) -> tuple[Column, Column]:
    """64 parities each of a line's characters and pairs of characters; an edit flips 2 and 4 of them at most."""

    def parities(codes: Column) -> Column:
        return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(c, F.lit(64)))))

    codes = F.transform(F.split(line, ""), F.ascii)
    pairs = F.transform(F.array(codes), lambda c: F.zip_with(c, F.slice(c, 2, F.size(c)), lambda x, y: F.pmod(x * 37 + F.coalesce(y, F.lit(0)) * 11, F.lit(64))))
    return parities(codes).alias("chars"), parities(F.get(pairs, F.lit(0))).alias("grams")


def _settled(lines: DataFrame) -> DataFrame:
    """(at) of lines (at, line) that are an earlier one but for a character left out of either or both.

    A line and its variants without one character meet by 128-bit hashes. A variant has no more lines than characters can stand
    at its places, so that what meets is small.
    """
    variant = F.concat(F.substring("line", F.lit(1), F.col("p") - 1), F.substring("line", F.col("p") + 1, F.length("line")))
    spelled = lines.select("at", "line", F.explode(F.sequence(F.lit(0), F.length("line"))).alias("p"))
    spelled = spelled.select("at", F.when(F.col("p") == 0, F.col("line")).otherwise(variant).alias("v"))
    hashed = spelled.select("at", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"))
    first = F.min("at").over(Window.partitionBy("h", "h2"))
    return hashed.withColumn("first", first).where("first < at").select("at").distinct()


def _leading(rows: DataFrame) -> DataFrame:
    """rows (id, key, own, ..) that are in a pair of a key, one of them an index line, whose later line is open, with the
    number n of the key's rows. Each key's bounds tell, so that no pair is made and a row stays once."""
    at, is_open = F.col("id.at"), F.col("id.open")
    bounds = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min(at).alias("low"), F.min(F.when(F.col("own"), at)).alias("own_low"),
        F.max(F.when(is_open, at)).alias("high"), F.max(F.when(is_open & F.col("own"), at)).alias("own_high"),
    )
    bounds = bounds.where((F.col("high") > F.col("own_low")) | (F.col("own_high") > F.col("low"))).withColumnRenamed("key", "k")
    later = is_open & (at > F.when(F.col("own"), F.col("low")).otherwise(F.col("own_low")))
    earlier = at < F.when(F.col("own"), F.col("high")).otherwise(F.col("own_high"))
    return rows.join(bounds, (F.col("key") == F.col("k")) & (later | earlier)).select(*rows.columns, "n")


def _split_keys(kept: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """(key, n, short_id, own) of keys that few lines share: those of kept, and in place of the others those of the residual
    texts, where a line of texts (.., open) is still open."""
    parts = max_edits + 1
    dense = kept.where(F.col("n") > SHARED_LINES)
    out = kept.where(F.col("n") <= SHARED_LINES).select("key", "n", "short_id", "own")
    held = texts.join(dense.select("short_id").distinct(), "short_id", "left_semi")
    cut = cuts(held.select(F.struct("short_id", "open", "at").alias("id"), F.lit(0).cast("long").alias("salt"), F.lit(True).alias("own"), "line"), max_edits)
    cut = stored(cut.join(dense.select("key").distinct(), "key", "left_semi").distinct(), "dense-lines")
    entries = _leading(cut).drop("n")
    if entries.isEmpty():
        return out.distinct()
    for level in range(LEVELS):
        # what is left of a line may be too short to be cut again
        short = F.length("rest") < F.when(F.col("own"), F.lit(parts)).otherwise(F.lit(parts + max_edits))
        ends = entries.where(F.length("rest") < parts + max_edits).select(
            "id", F.xxhash64("key", F.lit("end")).alias("key"), (F.col("own") & short).alias("own"), F.lit(None).cast("string").alias("rest")
        )
        again = cuts(entries.select("id", F.col("key").alias("salt"), "own", F.col("rest").alias("line")), max_edits).unionByName(ends).distinct()
        line = F.col("id.short_id")
        both = stored(_leading(again).select("key", "n", "id", "own", "rest"), "split-lines")
        few = (F.col("n") <= SHARED_LINES) | F.col("rest").isNull() | F.lit(level == LEVELS - 1)
        out = out.unionByName(both.where(few).select("key", "n", line.alias("short_id"), "own"))
        entries = both.where(~few).select("id", "key", "own", "rest")
        if entries.isEmpty():
            break
    return out.distinct()


def _near_pairs(kept: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """(later) of the lines that have an earlier one within the edits: the place of the later line.

    Signatures are part of the join's condition, so pairs that share a segment and little else are
    never made.
    """
    shared = kept.where(F.col("n") > SHARED_LINES).select("short_id").distinct()
    if max_edits >= 2 and not shared.isEmpty():
        settled = stored(_settled(texts.join(shared, "short_id", "left_semi").select("at", "line")), "settled-lines")
        open_texts = texts.join(settled.withColumn("found", F.lit(True)), "at", "left")
        texts = stored(open_texts.withColumn("open", F.col("found").isNull()).drop("found"), "line-texts")
    else:
        settled, texts = None, texts.withColumn("open", F.lit(True))
    if not shared.isEmpty():
        kept = stored(_split_keys(kept, texts, max_edits), "line-keys")
    signed = kept.join(texts.select("short_id", "size", "chars", "grams", "open"), "short_id")

    def side(role: Column, name: str) -> DataFrame:
        return signed.where(role).select("key", *[F.col(c).alias(f"{c}_{name}") for c in ("short_id", "size", "chars", "grams", "open")])

    def apart(column: str) -> Column:
        return F.bit_count(F.col(f"{column}_a").bitwiseXOR(F.col(f"{column}_b")))

    own, probe = side(F.col("own"), "a"), side(F.lit(True), "b")
    # the last pair of characters counts as one with nothing behind it, which an edit can flip as well
    close = (apart("chars") <= 2 * max_edits) & (apart("grams") <= 4 * max_edits) & (F.abs(F.col("size_a") - F.col("size_b")) <= max_edits)
    wanted = (F.col("short_id_a") != F.col("short_id_b")) & (F.col("open_a") | F.col("open_b")) & close
    met = own.alias("o").join(probe.alias("p"), (F.col("o.key") == F.col("p.key")) & wanted)
    pairs = met.select(F.least("short_id_a", "short_id_b").alias("a"), F.greatest("short_id_a", "short_id_b").alias("b")).distinct()
    left = texts.select(F.col("short_id").alias("a"), F.col("at").alias("at_a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("short_id").alias("b"), F.col("at").alias("at_b"), F.col("line").alias("line_b"))
    both = pairs.join(left, "a").join(right, "b")
    swap = F.length("line_a") < F.length("line_b")
    longer = F.when(swap, F.col("line_b")).otherwise(F.col("line_a")).alias("longer")
    shorter = F.when(swap, F.col("line_a")).otherwise(F.col("line_b")).alias("shorter")
    checked = both.select(longer, shorter, F.greatest("at_a", "at_b").alias("later"))
    found = checked.where(within_edits(F.col("longer"), F.col("shorter"), max_edits)).select("later")
    return found if settled is None else found.unionByName(settled.select(F.col("at").alias("later")))


def repeated_lines(docs: DataFrame, min_chars: int, max_edits: int) -> DataFrame:
    """(row, lines): for each row of docs (row, doc, text) the places of lines that an earlier one makes superfluous."""
    lines = docs.select("row", "doc", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)
    lines = lines.withColumns({"id": F.xxhash64("line"), "id2": F.xxhash64(F.lit(1), F.col("line"))})
    at = F.struct("doc", "row", "line_no")
    firsts = lines.groupBy("id", "id2").agg(F.count("*").alias("n"), F.min(at).alias("at")).select("id", "id2", "n", "at.*")
    firsts = stored(firsts, "first-lines")
    again = firsts.where("n > 1").select("id", "id2", at.alias("first"))
    exact = lines.join(again, ["id", "id2"]).where(at != F.col("first")).select("row", "line_no")
    exact = stored(exact.groupBy("row").agg(F.collect_set("line_no").alias("lines")), "equal-lines")
    # each distinct line makes its keys once
    new = _join_rows(docs.select("row", "text"), exact, "row", "left", exact.count())
    new = new.select(F.explode(_kept_lines(F.col("lines"))).alias("l")).select(F.trim("l.line").alias("line")).where(F.length("line") >= min_chars)
    near = near_lines(new.select(F.xxhash64("line").alias("id"), "line"), firsts, docs.select("row", "text"), max_edits)
    exact = exact.select("row", F.explode("lines").alias("line_no"))
    gone = exact.unionByName(near).groupBy("row").agg(F.collect_set("line_no").alias("lines"))
    return stored(gone, "gone-lines")


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, max_edits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with the text's superfluous lines removed, and n_lines and n_removed of each row.

    min_chars: lines below this stay. max_edits: edits up to which an earlier line replaces one, 10 at most.
    """
    if not 0 < max_edits <= 10:
        raise ValueError("max_edits must be from 1 to 10")
    if min_chars <= max_edits:
        raise ValueError("min_chars must exceed max_edits")
    kept = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_removed")]
    text = text_column(docs, text_col)
    doc = F.col(f"`{id_col}`")
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.length(doc.cast("string")), F.lit(-1)).cast("string"), doc.cast("string"), text)))
    rows = docs.select(
        key.alias("row"), doc.alias("doc"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest") if kept else F.lit(None).alias("rest")
    )
    gone = repeated_lines(rows.select("row", "doc", "text"), min_chars, max_edits)
    joined = _join_rows(rows, gone, "row", "left", gone.count())
    parts = F.split("text", "\n", -1)
    left = F.array_join(F.transform(_kept_lines(F.col("lines")), lambda k: k["line"]), "\n")
    return joined.select(
        F.col("doc").alias(id_col),
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(left).alias(text_col),
        *[F.col("rest").getField(c).alias(c) for c in kept],
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
    )
