"""The sync of trials: searches by term, one row for each agent, refresh or insert, and the sweep of statuses."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from curalake.functions.sentinel import strip
from curalake.functions.text import completion_label
from curalake.operators.studies import agents, interventional, relevant
from curalake.sources.shared import stored

#: Columns of a study that all of its rows have, and that a refresh brings up to date; a null doesn't overwrite.
STUDY_COLUMNS = ("trial_name", "phase", "sample_size", "completion", "primary_outcome", "sponsor_type", "overall_status")


@dataclass
class TrialSync:
    """The table after a sync, and what became of the studies."""

    rows: DataFrame
    counts: dict[str, int]


def filled_text(c: Column) -> Column:
    """The text without white space at its ends; null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def by_terms(results: Sequence[DataFrame], id_column: str, pos: str, seen: Observation) -> DataFrame:
    """The studies of all terms, each id once: as the first term that found it gave it, and there the first by pos.

    Rows without an id go; seen counts all rows, and these. Groups are reduced before they are shuffled.
    """
    every = None
    for term, df in enumerate(results):
        part = df.withColumn("_term", F.lit(term))
        every = part if every is None else every.unionByName(part)
    own = filled_text(F.col(id_column))
    every = every.withColumn(id_column, own).observe(seen, F.count("*").alias("found"), F.count_if(F.col(id_column).isNull()).alias("without_id"))
    columns = [c for c in every.columns if c not in ("_term", id_column)]
    first = F.min_by(F.struct(*columns), F.struct("_term", pos)).alias("_s")
    return every.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(first).select(id_column, "_s.*")


def trial_rows(studies: DataFrame, kinds: Sequence[str], agent: Callable[[Column], Column], phase: Callable[[Column], Column], sponsor: Callable[[Column], Column]) -> DataFrame:
    """F32: one row for each agent of a study, with the study's columns; `why` says why a study has none.

    studies: registry_id, title, study_type, phases, enrollment, completion_date, outcomes, sponsor_class, status,
    interventions (kind, name, other_names). Names that come to one agent are one row; a name that comes to none is none.
    """
    drugs = F.array_distinct(F.filter(F.transform(agents(F.col("interventions"), kinds), agent), lambda x: F.coalesce(x, F.lit("")) != ""))
    drugs = F.when(interventional(F.col("study_type")), F.coalesce(drugs, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    rows = studies.select(
        "registry_id",
        filled_text(F.col("title")).alias("trial_name"),
        phase(F.col("phases")).alias("phase"),
        F.col("enrollment").cast("long").alias("sample_size"),
        completion_label(filled_text(F.col("completion_date"))).alias("completion"),
        F.try_element_at(F.filter(F.transform("outcomes", filled_text), lambda x: x.isNotNull()), F.lit(1)).alias("primary_outcome"),
        sponsor(F.col("sponsor_class")).alias("sponsor_type"),
        F.upper(filled_text(F.col("status"))).alias("overall_status"),
        drugs.alias("drugs"),
    )
    why = F.when(F.size("drugs") == 0, "no agent")
    return rows.withColumn("why", why).withColumn("drug", F.explode_outer("drugs")).drop("drugs")


def sync_trials(
    results: Sequence[DataFrame],
    table: DataFrame,
    statuses: DataFrame,
    any_of: Sequence[str],
    pairs: Sequence[tuple[str, str]],
    kinds: Sequence[str],
    agent: Callable[[Column], Column],
    phase: Callable[[Column], Column],
    sponsor: Callable[[Column], Column],
) -> TrialSync:
    """Studies of all terms mapped to rows and merged into table (registry_id, drug, STUDY_COLUMNS and the curator's own columns).

    Rows of a trial that the table holds are refreshed, whatever their agent is called; other trials come in as new rows, whose
    curator's columns are null. Then statuses (registry_id, status) are swept over all trials of the table; null ones are skipped.
    What goes on the way is counted by metrics observed in the jobs that write the rows and the table, so nothing is read twice for it.
    """
    seen, mapped, merged = Observation(), Observation(), Observation()
    studies = by_terms(results, "registry_id", "pos", seen)
    keep = relevant(F.col("conditions"), any_of, pairs)
    rows = trial_rows(studies.withColumn("_keep", keep).observe(mapped, F.count("*").alias("unique"), F.count_if(~keep).alias("irrelevant")).where("_keep"), kinds, agent, phase, sponsor)
    none = Observation()
    rows = stored(rows.observe(none, F.count_if(F.col("why").isNotNull()).alias("without_agent")).where("why is null").drop("why"), "records")

    fresh = rows.groupBy("registry_id").agg(F.first(F.struct(*STUDY_COLUMNS)).alias("_new"))  # the rows of a study share these
    own = [c for c in table.columns if c not in ("registry_id", "drug", *STUDY_COLUMNS)]
    held = table.join(fresh, "registry_id", "left")
    value = lambda c: F.coalesce(F.col("_new")[c], F.col(c)).alias(c)
    kept = held.select("registry_id", "drug", *map(value, STUDY_COLUMNS), *own, F.when(F.col("_new").isNotNull(), "refreshed").otherwise("kept").alias("change"))
    new = rows.join(table.select("registry_id").distinct(), "registry_id", "left_anti")
    new = new.select("registry_id", "drug", *STUDY_COLUMNS, *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in own), F.lit("discovered").alias("change"))
    now = statuses.groupBy("registry_id").agg(F.max(F.upper(filled_text(F.col("status")))).alias("_now"))
    swept = kept.unionByName(new).join(now, "registry_id", "left")
    moved = F.coalesce(~F.col("overall_status").eqNullSafe(F.col("_now")) & F.col("_now").isNotNull(), F.lit(False))
    swept = swept.withColumn("moved", moved).withColumn("overall_status", F.coalesce("_now", "overall_status")).drop("_now")
    counts = [F.count_if(F.col("change") == c).alias(c) for c in ("refreshed", "discovered", "kept")]
    out = stored(swept.observe(merged, *counts, F.count_if("moved").alias("status_moved")), "trials")
    return TrialSync(out, seen.get | mapped.get | none.get | merged.get)
