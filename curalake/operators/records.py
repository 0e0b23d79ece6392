"""Records of articles, rounds of review and limits over time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalake.functions.sentinel import strip


def article(xml: Column) -> Column:
    """Title, authors (`Last I, ...`), year, DOI and text of an article record in XML; what isn't there is null."""
    text = lambda path: F.nullif(F.trim(F.xpath_string(xml, F.lit(path))), F.lit(""))
    last, initials = (F.xpath(xml, F.lit(f"//author/{part}/text()")) for part in ("last", "initials"))
    names = F.transform(F.arrays_zip(last.alias("l"), initials.alias("i")), lambda x: F.concat_ws(" ", x["l"], x["i"]))
    year = F.coalesce(text("//pubdate/year"), F.regexp_extract(text("//pubdate/other"), r"(\d{4})", 1))
    return F.struct(text("//title").alias("title"), F.nullif(F.array_join(names, ", "), F.lit("")).alias("authors"), F.nullif(year, F.lit("")).alias("year"), text("//id[@type='doi']").alias("doi"), F.array_join(F.xpath(xml, F.lit("//p/text()")), " ").alias("body"))


def service(urls: DataFrame, url: str, prefixes: DataFrame) -> DataFrame:
    """Each address with the service whose prefix it has; the longest prefix wins. prefixes (prefix, service) is a small table of settings."""
    hit = urls.join(F.broadcast(prefixes), F.startswith(F.col(url), F.col("prefix")), "left")
    return hit.groupBy(*urls.columns).agg(F.max_by("service", F.length("prefix")).alias("service"))


def duplicate_rows(df: DataFrame, columns: Sequence[str], pos: str) -> DataFrame:
    """Rows that repeat an earlier one in all columns, whatever the case, with the place of that one."""
    own = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.lower(F.col(c).cast("string")), F.lit("\x00")) for c in columns)).cast("binary"))
    rows = df.select(pos, own.alias("_own"))
    first = rows.groupBy("_own").agg(F.min(pos).alias("first_pos"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(first, "_own").where(F.col(pos) > F.col("first_pos")).select(pos, "first_pos")


def in_last(events: DataFrame, ts: str, seconds: int, counted: Column) -> DataFrame:
    """For each second with an event, how many counted ones the last `seconds` hold, over all clients.

    Counts are by second, and each second is also in the next span of that length, so a window holds two spans of seconds at most.
    """
    by_second = events.groupBy(F.unix_timestamp(ts).alias("second")).agg(F.count_if(counted).alias("n"))
    own = F.floor(F.col("second") / seconds)
    spans = by_second.withColumn("span", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy("span").orderBy("second").rangeBetween(-seconds, 0)
    return spans.withColumn("held", F.sum("n").over(w)).where(F.col("span") == own).select("second", "held")


def rulings(answers: DataFrame, subject: str, voter: str, version: str, at: str, answer: str, chair: Column, voters: int) -> DataFrame:
    """The standing of each subject: the latest answer of each voter to the current version; the chair's decides alone."""
    current = answers.groupBy(subject).agg(F.max(version).alias("_now"), F.max(at).alias("last_at"))
    live = answers.join(current, subject).where(F.col(version) == F.col("_now"))
    last = live.groupBy(subject, "last_at", voter).agg(F.max_by(answer, at).alias("_a"))
    tally = last.groupBy(subject, "last_at").agg(F.count_if(F.col("_a") == "yes").alias("yes"), F.count_if(F.col("_a") == "no").alias("no"), F.max(F.when(chair, F.col("_a"))).alias("ruling"))
    needed = -(-2 * voters // 3)
    standing = F.when(F.col("ruling").isin("yes", "no"), F.concat(F.lit("chair: "), F.col("ruling"))).when(F.col("yes") >= needed, "accepted").when(F.col("no") >= needed, "rejected").otherwise("open")
    return tally.select(subject, "yes", "no", standing.alias("standing"), "last_at")


def flag_counts(rows: DataFrame, keys: Sequence[str], flags: str, verdict: str) -> DataFrame:
    """Rows by verdict, and flags by name, of each key."""
    named = rows.select(*keys, F.explode(flags).alias("name")).groupBy(*keys, F.concat(F.lit("flag "), "name").alias("figure")).agg(F.count("*").alias("n"))
    return named.unionByName(rows.groupBy(*keys, F.concat(F.lit("verdict "), F.col(verdict)).alias("figure")).agg(F.count("*").alias("n")))


def pivoted(cells: DataFrame, keys: Sequence[str], column: str, value: str, names: Mapping[str, str]) -> DataFrame:
    """Cells as rows of a table, the named columns only; of several values in a cell the smallest."""
    return cells.groupBy(*keys).agg(*(F.min(F.when(F.col(column) == c, F.col(value))).alias(out) for c, out in names.items()))


def bearing(xrefs: Column, prefixes: Sequence[str]) -> Column:
    """The cross-references of a trait if one of them names a disease, else none."""
    names = F.exists(xrefs, lambda x: F.substring_index(x, ":", 1).isin(*prefixes))
    return F.when(names, F.array_distinct(F.filter(xrefs, lambda x: strip(x) != ""))).otherwise(F.array().cast("array<string>"))


def preconditions(checks: Mapping[str, Column]) -> Column:
    """An aggregate that is true, and fails with the names of all the checks that don't hold."""
    broken = F.array_join(F.filter(F.array(*(F.when(~ok, F.lit(n)) for n, ok in checks.items())), lambda x: x.isNotNull()), ", ")
    return F.when(broken == "", F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("round can't be read: "), broken)))
