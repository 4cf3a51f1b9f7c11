"""Ordered operators: islands, fills, supports, sums of blocks, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, partition: list[str], order: list[str], changed: Column, name: str = "island") -> DataFrame:
    """Number of the run a row belongs to: a running count of `changed` rows (an expression over LAG-ed columns already present)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(changed, 1).otherwise(0)).over(w))


def segments(pages: DataFrame, document: str, page: str, kind: str, absorb: tuple[str, ...] = ()) -> DataFrame:
    """Runs of pages of one kind: (document, segment, kind, first_page, last_page, pages). Kinds in `absorb` and nulls join the run before them."""
    own = F.when(~F.col(kind).isin(list(absorb)), F.col(kind)) if absorb else F.col(kind)
    w = Window.partitionBy(document).orderBy(page)
    carried = pages.withColumn("_kind", F.coalesce(F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col(kind)))
    flagged = carried.withColumn("_new", ~F.col("_kind").eqNullSafe(F.lag("_kind").over(w)) | (F.row_number().over(w) == 1))
    runs = islands(flagged, [document], [page], F.col("_new"), "segment")
    return runs.groupBy(document, "segment").agg(F.min("_kind").alias("kind"), F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("pages"))


def chains(tables: DataFrame, document: str, page: str, title: str, opens: Column) -> DataFrame:
    """Chain of each table: a table goes on with the one before if that was open, has its title and stands on the page before."""
    w = Window.partitionBy(document).orderBy(page)
    goes_on = F.lag(opens).over(w) & F.lag(title).over(w).eqNullSafe(F.col(title)) & (F.col(page) - F.lag(page).over(w) == 1)
    return islands(tables.withColumn("_new", ~F.coalesce(goes_on, F.lit(False))), [document], [page], F.col("_new"), "chain").drop("_new")


def code_fill(pages: DataFrame, document: str, page: str, code: str) -> DataFrame:
    """Unknown codes between two equal known ones take that code: adds `filled`."""
    w = Window.partitionBy(document).orderBy(page)
    before = F.last(code, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(code, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return pages.withColumn("filled", F.when(F.col(code).isNotNull(), F.col(code)).when(before == after, before))


def sequence_support(pages: DataFrame, document: str, page: str, sheet: str, reach: int = 3) -> DataFrame:
    """Number of other pages within `reach` that have the same offset of page and sheet: adds `support`."""
    w = Window.partitionBy(document, F.col(page) - F.col(sheet)).orderBy(page).rangeBetween(-reach, reach)
    return pages.withColumn("support", F.when(F.col(sheet).isNotNull(), F.count("*").over(w) - 1))


def sequence_smooth(pages: DataFrame, document: str, page: str, sheet: str) -> DataFrame:
    """A missing sheet number between two known ones of one linear run is interpolated: adds `smoothed`."""
    w = Window.partitionBy(document).orderBy(page)
    known = F.when(F.col(sheet).isNotNull(), F.struct(F.col(page).alias("p"), F.col(sheet).alias("s")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    linear = (after["p"] - before["p"]) == (after["s"] - before["s"])
    return pages.withColumn("smoothed", F.when(F.col(sheet).isNotNull(), F.col(sheet)).when(linear, before["s"] + F.col(page) - before["p"]))


def duplicate_of(pages: DataFrame, document: str, page: str, sheet: str) -> DataFrame:
    first = F.min(page).over(Window.partitionBy(document, sheet))
    return pages.withColumn("duplicate_of", F.when(F.col(sheet).isNotNull() & (first < F.col(page)), first))


def area_tolerance(n: Column) -> Column:
    """Rounding error to expect of a sum of n printed areas."""
    return 0.051 + 2 * 0.0289 * F.sqrt(n)


def sum_checks(rows: DataFrame, table: str, order: list[str], is_total: Column, value: str, tolerance=area_tolerance) -> DataFrame:
    """Each total against the sum of the data rows since the total before it: (table, block, n, sum, printed, delta, ok)."""
    w = Window.partitionBy(table).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.withColumn("_total", is_total).withColumn("block", F.coalesce(F.sum(F.when(F.col("_total"), 1).otherwise(0)).over(w), F.lit(0)))
    out = blocks.groupBy(table, "block").agg(F.count_if(~F.col("_total")).alias("n"), F.sum(F.when(~F.col("_total"), F.col(value))).alias("sum"), F.max(F.when(F.col("_total"), F.col(value))).alias("printed"))
    done = out.where("printed is not null").withColumn("delta", F.coalesce("sum", F.lit(0.0)) - F.col("printed"))
    return done.withColumn("ok", F.abs("delta") <= tolerance(F.col("n")))


def parent_child_sums(parents: DataFrame, children: DataFrame, key: str, parent_value: str, child_value: str, decimals: int = 2) -> DataFrame:
    """Parent values against the sum of their children, within half a unit of the last printed place for each child."""
    sums = children.groupBy(key).agg(F.sum(child_value).alias("children_sum"), F.count("*").alias("children"))
    out = parents.select(key, parent_value).join(sums, key, "left")
    delta = F.coalesce("children_sum", F.lit(0.0)) - F.col(parent_value)
    return out.withColumn("ok", F.coalesce(F.abs(delta) <= 0.5 * 10**-decimals * F.col("children"), F.lit(False)))


def natural_key(text: Column, width: int = 12) -> Column:
    """Text with each run of digits padded, so that text order is natural order."""
    parts = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def queue_order(rows: DataFrame, partition: list[str], order: list[Column], name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def global_order(rows: DataFrame, key: Column, order: list[Column], name: str = "place") -> DataFrame:
    """The place of each row in the order of `key`, and of `order` among rows of one key, without gathering all rows in one task.

    Rows are ranked within their key; only the keys with their counts are ranked among all, so a key should have far fewer values than there are rows.
    """
    keyed = rows.withColumn("_key", key)
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    before = counts.select("_key", (F.sum("_n").over(Window.orderBy("_key")) - F.col("_n")).alias("_before"))
    ranked = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
    return ranked.join(before, "_key").withColumn(name, (F.col("_before") + F.col("_k")).cast("bigint")).drop("_key", "_k", "_before")


def next_pending(queue: DataFrame, partition: list[str], place: str, pending: Column) -> DataFrame:
    """First pending place after each row, around the end of the queue: adds `next_place`."""
    w = Window.partitionBy(*partition).orderBy(place)
    here = F.when(pending, F.col(place))
    after = F.min(here).over(w.rowsBetween(1, Window.unboundedFollowing))
    return queue.withColumn("next_place", F.coalesce(after, F.min(here).over(Window.partitionBy(*partition))))


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the ordered rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of the ordered rows, each with the number of all rows in `total`; no rows beyond the end."""
    return page_of(rows, order, offset, limit).withColumn("total", F.lit(rows.count()))


def first_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key in order, keys with the number of rows that were passed over)."""
    rest = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"), (F.count("*") - 1).alias("passed_over"))
    return found.select(*keys, "_r.*").select(*rows.columns), found.where("passed_over > 0").select(*keys, "passed_over")


def lines_by_gap(words: DataFrame, page: str, y: str, x: str, gap: float) -> DataFrame:
    """Words of a page gathered into lines by vertical gaps: adds `line`; order inside a line is by x."""
    w = Window.partitionBy(page).orderBy(y, x)
    return islands(words.withColumn("_new", F.coalesce(F.col(y) - F.lag(y).over(w) > gap, F.lit(True))), [page], [y, x], F.col("_new"), "line").drop("_new")


def nearest_before(marks: DataFrame, values: DataFrame, document: str, position: str, mark: str, reach: int) -> DataFrame:
    """As-of join: each value with the last mark before it within `reach` places. One ordered pass over the union of both."""
    both = marks.select(document, position, F.col(mark).alias("_mark"), F.lit(0).alias("_side")).unionByName(values.select(document, position, F.lit(None).cast(marks.schema[mark].dataType).alias("_mark"), F.lit(1).alias("_side")))
    w = Window.partitionBy(document).orderBy(position, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(F.col(position).alias("p"), F.col("_mark").alias("m"))), ignorenulls=True).over(w)
    out = both.withColumn("_seen", seen).where("_side = 1")
    return out.select(document, position, F.when(F.col(position) - F.col("_seen.p") <= reach, F.col("_seen.m")).alias(mark))
