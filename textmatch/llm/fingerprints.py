"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.llm.common import range_indexed, stored

#: Where a text is cut into paragraphs: at line ends, and inside a line after a sentence of 30 characters or more.
CUTS = r"\n| (?<=[.!?] )(?<=[^.!?\n]{30}[.!?] )"
#: Cells of a sketch: three thirds, in each of which a digest has one cell.
CELLS, THIRD = 24, 8
#: A sketch that can't be peeled is done again as several, each of a part of the digests: about so many digests a part, at
#: most so many parts at once, and at most so often.
EACH, PARTS, LEVELS = 8, 16, 12
#: Rows without doc_id are dealt to so many parts.
SALTS = 64

CELL = "struct<n:int,key:bigint,check:bigint>"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs, in order of first occurrence."""
    return F.array_distinct(F.transform(F.split(text, CUTS), lambda p: F.xxhash64(p)))


def _check(item: Column) -> Column:
    return F.xxhash64(item, F.lit(-1).cast("long"))


def _placed(n: Column, item: Column, level: int) -> Column:
    """A digest with its check and its three cells; each level hashes anew."""
    mixed = F.xxhash64(item, F.lit(level).cast("long"))
    at = [(F.shiftright(mixed, 3 * j).bitwiseAND(F.lit(THIRD - 1)) + j * THIRD).cast("int").alias(f"p{j}") for j in range(3)]
    return F.struct(n.cast("int").alias("n"), item.alias("key"), _check(item).alias("check"), *at)


def _added(cells: Column, placed: Column, sign: int) -> Column:
    """Cells with a placed digest put in or, sign being -1, taken out: counts add up, digests and checks are xor-ed."""

    def one(c: Column, i: Column) -> Column:
        changed = F.struct((c["n"] + sign * placed["n"]).cast("int").alias("n"), c["key"].bitwiseXOR(placed["key"]).alias("key"), c["check"].bitwiseXOR(placed["check"]).alias("check"))
        return F.when((i == placed["p0"]) | (i == placed["p1"]) | (i == placed["p2"]), changed).otherwise(c)

    return F.transform(cells, one)


def sketch(items: Column, level: int = 0) -> Column:
    """Cells of a set of digests: how many are in a cell, and the exclusive ors of them and of their checks."""
    empty = F.array_repeat(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check")), F.lit(CELLS))
    return F.aggregate(F.transform(items, lambda x: _placed(F.lit(1), x, level)), empty, lambda cells, x: _added(cells, x, 1))


def subtracted(a: Column, b: Column) -> Column:
    """The sketch of what is in a and not in b (counted 1) or in b and not in a (counted -1)."""
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peeled(cells: Column, level: int = 0) -> Column:
    """A subtracted sketch taken apart: struct of only_a and only_b, the digests recovered, and left, whether some stay hidden.

    In each step, a cell that holds a single digest gives it up, and it is taken out of its cells. That empties a cell for
    good, so there are at most as many steps as cells; without such a cell, nothing happens any more.
    """
    none = F.array().cast("array<bigint>")

    def step(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"])))
        first = F.transform(F.slice(single, 1, 1), lambda c: _placed(c["n"], c["key"], level))
        stuck = F.struct(state["cells"].alias("cells"), state["only_a"].alias("only_a"), state["only_b"].alias("only_b"), F.lit(True).alias("stuck"))
        taken = F.aggregate(first, stuck, lambda s, x: F.struct(
            _added(s["cells"], x, -1).alias("cells"),
            F.when(x["n"] > 0, F.concat(s["only_a"], F.array(x["key"]))).otherwise(s["only_a"]).alias("only_a"),
            F.when(x["n"] < 0, F.concat(s["only_b"], F.array(x["key"]))).otherwise(s["only_b"]).alias("only_b"),
            F.lit(False).alias("stuck"),
        ))
        return F.when(state["stuck"], state).otherwise(taken)

    start = F.struct(cells.alias("cells"), none.alias("only_a"), none.alias("only_b"), F.lit(False).alias("stuck"))
    left = lambda s: F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["check"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(CELLS)), start, step, lambda s: F.struct(s["only_a"].alias("only_a"), s["only_b"].alias("only_b"), left(s).alias("left")))


def printed(n: Column, cells: Column) -> Column:
    """A fingerprint as text: the number of digests, then the cells of the sketch in base64 (count, digest, check; 20 bytes each).

    Cells are sums, so order doesn't matter and equal texts have equal fingerprints. Two fingerprints whose sets differ in
    few digests can be subtracted and peeled as they are.
    """
    cell = lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["check"]), 16, "0"))
    return F.concat(n.cast("string"), F.lit(":"), F.translate(F.base64(F.unhex(F.array_join(F.transform(cells, cell), ""))), "\r\n", ""))


def told(a: Column, b: Column, level: int = 0) -> Column:
    """peeled(), for two sets of digests."""
    return peeled(subtracted(sketch(a, level), sketch(b, level)), level)


def larger(failed: DataFrame, ids: list[str], items: bool = True) -> DataFrame:
    """Differences of pairs (ids, a, b) whose sketches at level 0 can't be peeled, from larger and larger sketches.

    At each retry, the digests of what failed are parted by their next bits, in as many parts as leave about EACH for one
    if all of them differ, and each part is sketched in as many cells as the whole was. So a sketch is larger where it has
    to be, and grows with the sets. All of it happens inside rows: nothing is shuffled, and the work is linear in the
    digests. What no retry has told after LEVELS (digests that don't part, of which there are hardly any) is told by
    comparing the sets. Returns ids, only_a and only_b, several rows a pair: arrays, or with items off their sizes.
    """
    rows, done = failed.select(*ids, "a", "b", F.lit(0).alias("bits")), []
    out = [F.col(f"t.{c}") if items else F.size(f"t.{c}").alias(c) for c in ("only_a", "only_b")]
    for level in range(1, LEVELS + 1):
        wanted = F.ceil(F.log2((F.size("a") + F.size("b")) / EACH))
        width = F.greatest(F.lit(1), F.least(F.lit(PARTS.bit_length() - 1), wanted)).cast("int")
        rows = rows.withColumn("width", width).withColumn("mask", F.call_function("shiftleft", F.lit(1), F.col("width")) - 1)

        def part(items: str, k: Column) -> Column:
            return F.filter(items, lambda x: F.call_function("shiftrightunsigned", x, F.col("bits")).bitwiseAND(F.col("mask").cast("long")) == k).alias(items)

        parts = F.explode(F.transform(F.sequence(F.lit(0), F.col("mask")), lambda k: F.struct(part("a", k), part("b", k))))
        rows = rows.withColumn("p", parts).withColumn("bits", F.col("bits") + F.col("width")).select(*ids, "bits", "p.a", "p.b").where("size(a) + size(b) > 0")
        rows = rows.withColumn("t", told(F.col("a"), F.col("b"), level))
        again = [F.when(F.col("t.left"), F.col(c)).alias(c) for c in ("a", "b")]
        table = stored(rows.select(*ids, *out, F.col("t.left").alias("left"), "bits", *again))
        done.append(table.where("not left").select(*ids, "only_a", "only_b"))
        rows = table.where("left").select(*ids, "a", "b", "bits")
        if not rows.limit(1).count():
            break
    else:
        exact = [F.array_except("a", "b"), F.array_except("b", "a")]
        done.append(rows.select(*ids, *[(x if items else F.size(x)).alias(c) for x, c in zip(exact, ("only_a", "only_b"), strict=True)]))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def differences(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """What tells two versions of a document apart, recovered from their sketches: ids, side, digest.

    pairs: the ids columns, and arrays a and b of distinct digests. side is "a" or "b", the version that has the digest.
    Pairs whose sketch can't be peeled empty are done again with larger ones, so every difference is found.
    """
    base = stored(pairs.select(*ids, "a", "b", told(F.col("a"), F.col("b")).alias("t")))
    rows = base.where("not t.left").select(*ids, "t.only_a", "t.only_b").unionByName(larger(base.where("t.left"), ids))
    sides = [rows.select(*ids, F.lit(side).alias("side"), F.explode(f"only_{side}").alias("digest")) for side in ("a", "b")]
    return sides[0].unionByName(sides[1])


def next_documents(keys: DataFrame) -> DataFrame:
    """(key, next_key) of a table (key, doc_id): the following doc_id in ascending order, the first after the last; null comes first."""
    ids = range_indexed(keys.distinct(), ["doc_id"], {})
    ids = stored(ids.select("key", "__idx"))
    n = max(1, ids.count())
    after = ids.select(F.col("key").alias("next_key"), F.col("__idx").alias("__at"))
    return ids.join(after.hint("merge"), F.pmod(F.col("__idx") + 1, F.lit(n)) == F.col("__at")).select("key", "next_key")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness and the next document's.

    docs: doc_id, text; one row out for each row in: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text is the document with its last quarter (rounded down) of code points replaced
    by as many (or all) first ones of the next document in ascending doc_id. Likeness is the share of common digests in
    all digests of the two: their fingerprints are subtracted and peeled, and where these are too small for what differs,
    larger sketches are (see larger()).

    Texts are shuffled once, by doc_id, and that shuffle is read twice: a next document sends its digests and the code
    points wanted only, and the document receives them. Rows without doc_id are dealt to SALTS parts.

    Defined results: null text is empty, and an empty text has one empty paragraph; rows repeated with equal doc_id and
    text get equal rows; where a doc_id has several texts, the one with the smallest hash is its neighbour's next; an
    empty table gives an empty table; other columns are not read.
    """
    text, key = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(text), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"), text.alias("text"))
    rows = rows.repartition("key", "salt")
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("key") == "", SALTS - 1).otherwise(0)))
    wanted = docs.select(key.alias("key"), F.floor(F.length(text) / 4).alias("take")).groupBy("key").agg(F.max("take").alias("take"))
    order = next_documents(docs.select(key.alias("key"), "doc_id"))
    needs = wanted.join(order.hint("merge"), "key").select(F.col("key").alias("for_key"), F.col("next_key").alias("key"), "take")
    needs = stored(needs.select("for_key", "key", "take", salts.alias("salt")))
    head = F.substring("text", F.lit(1), F.col("take").cast("int"))
    sent = rows.join(needs.hint("merge"), ["key", "salt"]).select("for_key", F.struct(F.xxhash64("text").alias("h"), head.alias("head"), digests(F.col("text")).alias("next")).alias("s"))
    sent = sent.groupBy(F.col("for_key").alias("key")).agg(F.min("s").alias("s")).select("key", "s", salts.alias("salt"))
    met = rows.join(sent.hint("merge"), ["key", "salt"])
    n = F.length("text")
    take = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - take), F.substring("s.head", F.lit(1), take))
    made = met.select("key", n.cast("long").alias("n_chars"), F.unhex(F.sha2(edited, 256)).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(edited).alias("new"), F.col("s.next").alias("next"))
    versions = ("new", "next")
    made = made.withColumns({f"c_{c}": sketch(F.col(c)) for c in ("own", *versions)})
    made = made.withColumns({f"t_{c}": peeled(subtracted(F.col("c_own"), F.col(f"c_{c}"))) for c in versions})
    counts = [F.struct(F.size(f"t_{c}.only_a").alias("a"), F.size(f"t_{c}.only_b").alias("b"), F.col(f"t_{c}.left").alias("left")).alias(f"t_{c}") for c in versions]
    made = made.select("key", "n_chars", "edited_sha256", "own", "new", F.when(F.col("t_next.left"), F.col("next")).alias("next"), *counts)
    base = stored(made.withColumn("row", F.monotonically_increasing_id()))

    failed = F.explode(F.array(*[F.struct(F.lit(c).alias("version"), F.when(F.col(f"t_{c}.left"), F.col(c)).alias("b")) for c in versions]))
    failed = base.select("row", F.col("own").alias("a"), failed.alias("f")).where("f.b is not null").select("row", "f.version", "a", "f.b")
    more = larger(failed, ["row", "version"], items=False)
    sums = [F.sum(F.when(F.col("version") == c, F.col(f"only_{x}")).otherwise(0)).alias(f"{c}_{x}") for c in versions for x in ("a", "b")]
    out = base.join(stored(more.groupBy("row").agg(*sums)).hint("merge"), "row", "left")

    def near(c: str) -> Column:
        only = {x: F.when(F.col(f"t_{c}.left"), F.col(f"{c}_{x}")).otherwise(F.col(f"t_{c}.{x}")) for x in ("a", "b")}
        return (F.size("own") - only["a"]) / (F.size("own") + only["b"])

    return out.select(
        F.nullif("key", F.lit("")).cast("long").alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        *[printed(F.size(c), sketch(F.col(c))).alias(f"{name}fingerprint") for c, name in (("own", ""), ("new", "edited_"))],
        near("new").alias("near_edited"), near("next").alias("near_next"),
    )
