"""Contract checks: every rule is an aggregate, every audit a table of (name, status, detail)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of severity of an audit's rows.
SEVERITY = ("PASS", "WARNING", "FAIL")
#: Name parts that a label table may not have.
SCORE_WORDS = ("score", "probability", "prediction", "rank", "auprc", "auroc")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def refuse_columns(df: DataFrame, words: Sequence[str] = SCORE_WORDS) -> None:
    found = sorted(c for c in df.columns if any(w in c.lower() for w in words))
    if found:
        raise ValueError(f"columns that may not be there: {found}")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """name, bad_rows for row rules (a column that is true where a row breaks the rule), in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "name", "bad_rows")


def repeats(df: DataFrame, keys: Sequence[str], name: str = "unique_key") -> DataFrame:
    """name, bad_rows: how many rows repeat a key."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.lit(name).alias("name"), F.coalesce(F.sum("extra"), F.lit(0)).alias("bad_rows"))


def judged(checks: DataFrame, warnings: Sequence[str] = ()) -> DataFrame:
    """Adds status: PASS without bad rows, else FAIL, or WARNING for the names given."""
    bad = F.when(F.col("name").isin(list(warnings)), "WARNING").otherwise("FAIL") if warnings else F.lit("FAIL")
    return checks.withColumn("status", F.when(F.col("bad_rows") == 0, "PASS").otherwise(bad))


def overall(checks: DataFrame) -> DataFrame:
    """One row: the worst status and how many checks there are of each."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status"))
    worst = F.element_at(F.array(*map(F.lit, SEVERITY)), F.max(rank).cast("int"))
    return checks.agg(worst.alias("status"), *[F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in SEVERITY])


def power_gate(labels: DataFrame, gene: str, context: str, fold: str, label: str, holdout: int, thresholds: Mapping[str, int]) -> DataFrame:
    """Five counts of positives against their thresholds, with PASS or WAIT and the failures."""
    refuse_columns(labels)
    yes = F.col(label) == 1
    held = yes & (F.col(fold) == holdout)
    values = labels.agg(
        F.count_if(yes).alias("positive_pairs"), F.count_distinct(F.when(yes, F.col(gene))).alias("positive_genes"),
        F.count_distinct(F.when(yes, F.col(context))).alias("indications_with_positive"),
        F.count_if(held).alias("holdout_positive_pairs"), F.count_distinct(F.when(held, F.col(gene))).alias("holdout_positive_genes"),
    )
    low = F.filter(F.array(*[F.when(F.col(n) < t, F.lit(n)) for n, t in thresholds.items()]), lambda x: x.isNotNull())
    return values.withColumn("failures", F.concat_ws(",", low)).withColumn("gate", F.when(F.col("failures") == "", "PASS").otherwise("WAIT"))


def leakage_status(shared: Column, has_corpus: Column) -> Column:
    return F.when(~has_corpus, "UNRESOLVED").when(shared > 0, "OVERLAP").otherwise("CLEAN")


def content_seal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n_rows, hash_sum, hash_xor of canonical row strings: equal for equal contents in any order or layout."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return df.select(number.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.bit_xor("h").alias("hash_xor"))


#: The columns of a candidate table, numbers and others.
CANDIDATE_NUMBERS = (
    "label_pre_cutoff", "label_post_cutoff", "publication_count_pre_cutoff", "publication_count_all_time", "mean_expression_id", "mean_expression_ood", "differential_expression_id",
    "differential_expression_ood", "cell_type_specificity_id", "cell_type_specificity_ood", "network_centrality", "druggable_class", "cutoff_year", "evaluation_end_year",
)
CANDIDATE_OTHERS = ("gene_id", "planted_group", "entry_year")
PLANTED = ("biology_signal", "popularity_only", "noise")
#: The columns of an index of contextual vectors; the first five are its key.
CONTEXT_INDEX = ("gene_id", "disease", "cell_compartment", "treatment_state", "response_state", "n_cells", "n_samples")


def _finite(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def candidate_contract(df: DataFrame) -> DataFrame:
    """name, bad_rows, status of the 17-column candidate table; a missing column raises.

    One pass over the rows and one grouping by gene.  A negative count, a share
    outside of [0, 1] and all-time counts below the earlier ones are warnings.
    """
    require_columns(df, [*CANDIDATE_OTHERS, *CANDIDATE_NUMBERS])
    share = lambda *names: ~reduce(lambda a, b: a & b, [F.col(n).between(0, 1) for n in names])
    rules = {
        "gene_is_named": F.col("gene_id").isNull(),
        "numbers_are_finite": ~reduce(lambda a, b: a & b, map(_finite, CANDIDATE_NUMBERS)),
        "labels_are_binary": ~(F.col("label_pre_cutoff").isin(0, 1) & F.col("label_post_cutoff").isin(0, 1)),
        "labels_do_not_overlap": (F.col("label_pre_cutoff") == 1) & (F.col("label_post_cutoff") == 1),
        "labels_follow_entry": (F.col("label_pre_cutoff") + F.col("label_post_cutoff") == 1) & F.col("entry_year").isNull(),
        "group_is_known": ~F.col("planted_group").isin(*PLANTED),
        "popularity_only_never_enters": (F.col("planted_group") == "popularity_only") & (F.col("label_post_cutoff") == 1),
        "class_is_binary": ~F.col("druggable_class").isin(0, 1),
        "cutoff_before_end": F.col("cutoff_year") >= F.col("evaluation_end_year"),
        "counts_are_not_negative": (F.col("publication_count_pre_cutoff") < 0) | (F.col("publication_count_all_time") < 0),
        "counts_grow": F.col("publication_count_all_time") < F.col("publication_count_pre_cutoff"),
        "shares_in_range": share("cell_type_specificity_id", "cell_type_specificity_ood", "network_centrality"),
    }
    return judged(violations(df, rules).union(repeats(df, ["gene_id"], "gene_is_unique")), ["counts_are_not_negative", "counts_grow", "shares_in_range"])


def context_artefact(index: DataFrame, pretrained: DataFrame, random: DataFrame, manifest: Mapping[str, object], intact: Mapping[str, bool], protocol: str | None = None) -> DataFrame:
    """name, status, bad of the invariants of an artefact of contextual vectors.

    `index` has CONTEXT_INDEX and row, the two matrices row and embedding; the
    manifest has rows, width, contexts and protocol_sha256.  `intact` says for
    index, pretrained and random whether the file is there and as sealed; with
    the hash of a protocol there are 16 invariants, without it 15.
    """
    spark = index.sparkSession
    there = [(f"{name}_exists", int(name not in intact)) for name in ("index", "pretrained", "random")]
    sealed = [(f"{name}_hash", int(not intact.get(name, False))) for name in ("index", "pretrained", "random")]
    linked = [] if protocol is None else [("protocol_hash", int(manifest.get("protocol_sha256") != protocol))]
    schema = [("index_schema", len(set(CONTEXT_INDEX) - set(index.columns)))]
    known = spark.createDataFrame([*there, *sealed, *linked, *schema], "name string, bad long")
    if schema[0][1] or any(bad for _, bad in there):
        return _told(known)

    key = list(CONTEXT_INDEX[:5])
    one = lambda df, name, bad: df.agg(F.lit(name).alias("name"), bad.cast("long").alias("bad"))
    low = index.agg(F.count_if(~F.coalesce((F.col("n_cells") > 0) & (F.col("n_samples") > 0), F.lit(False))).alias("positive_support_counts"), F.count_if(F.col("n_samples") < 2).alias("multi_sample_support"))
    support = low.unpivot([], low.columns, "name", "bad")
    contexts = one(index.select(*key[1:]).distinct(), "context_count", F.abs(F.count(F.lit(1)) - F.lit(manifest["contexts"])))
    repeated = repeats(index, key, "unique_gene_context_rows").withColumnRenamed("bad_rows", "bad")

    # both matrices in one pass
    both = pretrained.select(F.lit("pretrained").alias("of"), "embedding").unionByName(random.select(F.lit("random").alias("of"), "embedding"))
    ok = F.coalesce(F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))
    add = lambda power: F.sum(F.when(ok, F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double"), F.lit(power)))))
    n = F.sum(F.when(ok, F.size("embedding")))
    wrong = F.abs(F.count(F.lit(1)) - F.lit(manifest["rows"])) + F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != manifest["width"])
    spread = F.coalesce(add(2.0) / n - F.pow(add(1.0) / n, F.lit(2.0)), F.lit(0.0))
    health = both.groupBy("of").agg(wrong.alias("shape"), F.count_if(~ok).alias("unfinite"), (spread <= 1e-12).cast("long").alias("flat"))
    health = health.groupBy().agg(
        F.sum("shape").alias("matrix_shape_match"), F.sum("unfinite").alias("finite_embeddings"),
        *[F.coalesce(F.max(F.when(F.col("of") == of, F.col("flat"))), F.lit(1)).alias(f"nondegenerate_{of}") for of in ("pretrained", "random")],
    )
    vectors = health.unpivot([], health.columns, "name", "bad")
    return _told(reduce(lambda a, b: a.unionByName(b), [support, contexts, repeated, vectors], known))


def _told(checks: DataFrame) -> DataFrame:
    return judged(checks.withColumnRenamed("bad", "bad_rows"), ["multi_sample_support"]).withColumnRenamed("bad_rows", "bad")
