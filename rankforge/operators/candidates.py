"""The 17-column candidate table from records of events, as of a cutoff.

A record says that an entity was seen on a day, in one of two domains, in a group, as
a case or a control, with a value and a level.  Features come from records up to the
cutoff year alone; later ones only decide labels and the all-time count.  One pass
over the records gives all of an entity's sums, another one those by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.operators.contracts import CANDIDATE_NUMBERS, CANDIDATE_OTHERS

DOMAINS = ("id", "ood")


def candidate_table(entities: DataFrame, records: DataFrame, cutoff: int, end: int, places: DataFrame | None = None) -> DataFrame:
    """`entities` has gene_id and druggable_class; `records` has gene_id, year, ood, grp, place, is_case, is_entry, value and level.

    An entry is the first year with an entry record; a mean or a contrast that a
    domain lacks is 0, as is the share of an entity without values there.  Centrality
    is the share of all places that an entity was seen at; `places` has them in
    place, with repeats, where that is less work than to take them from the records.
    Nothing is planted in records, so every planted_group is noise.
    """
    known = F.col("year") <= cutoff
    where = {"id": known & ~F.col("ood"), "ood": known & F.col("ood")}
    mean = lambda c, rows: F.avg(F.when(rows, F.col(c)))
    sums: dict[str, Column] = {
        "entry_year": F.min(F.when(F.col("is_entry"), F.col("year"))), "publication_count_pre_cutoff": F.count_if(known), "publication_count_all_time": F.count(F.lit(1)),
        "seen_at": F.count_distinct(F.when(known, F.col("place"))),
    }
    for d, rows in where.items():
        sums[f"mean_expression_{d}"] = mean("value", rows)
        sums[f"differential_expression_{d}"] = mean("level", rows & F.col("is_case")) - mean("level", rows & ~F.col("is_case"))
    plain = records.groupBy("gene_id").agg(*[c.alias(n) for n, c in sums.items()])
    grouped = records.where(known).groupBy("gene_id", "grp").agg(*[F.sum(F.when(rows, F.col("value"))).alias(d) for d, rows in where.items()])
    shares = grouped.groupBy("gene_id").agg(*[F.try_divide(F.max(d), F.sum(d)).alias(f"cell_type_specificity_{d}") for d in DOMAINS])
    every = (records if places is None else places).agg(F.count_distinct("place").alias("places"))
    made = entities.join(plain, "gene_id", "left").join(shares, "gene_id", "left").crossJoin(F.broadcast(every))  # one row
    year = F.col("entry_year")
    made = made.withColumns({
        "planted_group": F.lit("noise"), "entry_year": year.cast("int"), "label_pre_cutoff": F.coalesce((year <= cutoff).cast("int"), F.lit(0)),
        "label_post_cutoff": F.coalesce(((year > cutoff) & (year <= end)).cast("int"), F.lit(0)), "network_centrality": F.coalesce(F.col("seen_at") / F.col("places"), F.lit(0.0)),
        "cutoff_year": F.lit(cutoff), "evaluation_end_year": F.lit(end),
        **{c: F.coalesce(c, F.lit(0)).cast("long") for c in ("publication_count_pre_cutoff", "publication_count_all_time")},
        **{f"{c}_{d}": F.coalesce(F.col(f"{c}_{d}").cast("double"), F.lit(0.0)) for c in ("mean_expression", "differential_expression", "cell_type_specificity") for d in DOMAINS},
    })
    return made.select(*CANDIDATE_OTHERS, *CANDIDATE_NUMBERS)
