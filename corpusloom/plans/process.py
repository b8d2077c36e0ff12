"""Split first, then process the training side by recipe."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.bounded import checked, join_checked
from corpusloom.functions import entities as ent, keys, lexical, text as tx
from corpusloom.operators import sampling, windows
from corpusloom.schemas import require
from corpusloom.session import materialise, spread
from corpusloom.sources import audit, files

# ---- fixed values -------------------------------------------------------
RECIPE_1 = {
    "splitting": {
        "train_ratio": 0.9,
        "test_ratio": 0.1,
        "sample_by_topic_parity": {"enabled": True, "min_topic_size": 100},
        "stratified_sample": {"enabled": True, "sample_n": 20_000, "stratify_by": ["is_bs"]},
    },
    "processing": {},
}
RECIPE_2 = {
    "splitting": {
        "train_ratio": 0.9,
        "test_ratio": 0.1,
        "sample_by_topic_parity": {"enabled": True, "min_topic_size": 30},
        "stratified_sample": {"enabled": True, "sample_n": 35_000, "stratify_by": ["is_bs"]},
    },
    "processing": {
        "remove_duplicates": True,
        "normalize_text_length": {"enabled": True, "min_tokens": 150, "max_tokens": 1000},
        "clean_text": True,
        "mask_entities": {"enabled": True},
        "filter_low_lexical_diversity": {"enabled": True, "min_hhd_threshold": 0.7},
    },
}
# ---- end of fixed values ------------------------------------------------
_STEP_KEYS = {
    "remove_duplicates": {"enabled"},
    "normalize_text_length": {"enabled", "min_tokens", "max_tokens"},
    "clean_text": {"enabled"},
    "mask_entities": {"enabled", "entity_types"},
    # the threshold goes by either spelling
    "filter_low_lexical_diversity": {"enabled", "min_hhd_threshold", "min_hdd_threshold"},
}


def check_steps(steps: Mapping) -> None:
    """Unknown steps and keys are errors: a misspelt threshold must not pass for the default."""
    for name, step in steps.items():
        if name not in _STEP_KEYS:
            raise ValueError(f"unknown processing step {name}")
        unknown = set(step) - _STEP_KEYS[name] if isinstance(step, Mapping) else set()
        if unknown:
            raise ValueError(f"{name} has no {sorted(unknown)}")


def scaled(recipe: Mapping, min_topic_size: int, sample_n: int, **lengths) -> dict:
    """A recipe with sizes that fit a smaller corpus."""
    split = dict(recipe["splitting"])
    split["sample_by_topic_parity"] = dict(
        split["sample_by_topic_parity"], min_topic_size=min_topic_size
    )
    split["stratified_sample"] = dict(split["stratified_sample"], sample_n=sample_n)
    steps = dict(recipe["processing"])
    if lengths:
        steps["normalize_text_length"] = dict(steps["normalize_text_length"], **lengths)
    return {"splitting": split, "processing": steps}


def unsampled(recipe: Mapping) -> dict:
    """A recipe whose split deals out every row; its ratios, strata and processing stay."""
    split = dict(recipe["splitting"])
    for step in ("sample_by_topic_parity", "stratified_sample"):
        split[step] = dict(split[step], enabled=False)
    return dict(recipe, splitting=split)


def split_corpus(df: DataFrame, recipe: Mapping, seed: int = keys.SEED) -> DataFrame:
    """Topic parity, balanced sample, stratified split: adds ``split``.

    All decisions are made on a written table of ids, topics and strata, so that
    whatever made the corpus runs once for it and once for the result.  The
    wide rows are only compared with small tables: no text is shuffled.
    """
    cfg = recipe.get("splitting", {})
    train_ratio, test_ratio = cfg.get("train_ratio", 0.9), cfg.get("test_ratio", 0.1)
    sampling.check_ratios(train_ratio, test_ratio)
    parity = cfg.get("sample_by_topic_parity", {})
    sample = cfg.get("stratified_sample", {})
    stratify_by = sample.get("stratify_by", [])
    needed = ["row_id", *(["topic"] if _enabled(parity) else []), *stratify_by]
    ids = materialise(require(df, *needed).select(*dict.fromkeys(needed)), "split-keys")
    if _enabled(parity):
        topics = checked(sampling.large_topics(ids, parity.get("min_topic_size", 100)))
        ids, df = (d.join(topics, "topic", "left_semi") for d in (ids, df))
    if _enabled(sample):
        cut = sampling.balanced_cut(ids, stratify_by, sample.get("sample_n"), seed=seed)
        ids, df = cut.keep(ids), cut.keep(df)
    return sampling.name_sides(
        sampling.split_cut(ids, test_ratio, stratify_by, seed=seed).flag(df)
    )


def _enabled(step) -> bool:
    return bool(step.get("enabled")) if isinstance(step, Mapping) else bool(step)


def staged(df: DataFrame, steps: Mapping, text_col: str = "text", id_col: str = "row_id"):
    """All steps as columns of one frame: row flags and the rewritten text.

    Returns the frame and the audit stages ``(name, came, went, changed)``.
    Nothing is filtered yet, so one pass serves the result and its audit; later
    steps are not evaluated on rows that an earlier step dropped.
    """
    check_steps(steps)
    never = F.lit(False)
    alive = F.lit(True)
    stages = []
    out = df.withColumn("_text0", F.col(text_col))
    if _enabled(steps.get("remove_duplicates", False)):
        later = windows.repeated(df, text_col, id_col).withColumn("_later", F.lit(True))
        out = join_checked(out, later, id_col, "left").withColumn("_first", F.col("_later").isNull()).drop("_later")
        stages.append(("remove_duplicates", alive, F.col("_first"), never))
        alive = F.col("_first")
    length = steps.get("normalize_text_length", {})
    if _enabled(length):
        if length.get("max_tokens") is None:
            raise ValueError("normalize_text_length needs max_tokens")
        fits = tx.text_length(F.col("_text0"), "words").between(
            length.get("min_tokens", 0), length["max_tokens"]
        )
        out = out.withColumn("_fits", F.when(alive, F.coalesce(fits, never)).otherwise(False))
        stages.append(("normalize_text_length", alive, F.col("_fits"), never))
        alive = F.col("_fits")
    if _enabled(steps.get("clean_text", False)):
        out = out.withColumn("_text1", F.when(alive, tx.clean_text(F.col(text_col)))).withColumn(
            "_clean", F.coalesce(F.col("_text1") != F.col(text_col), never)
        )
        out = out.withColumn(text_col, F.col("_text1"))
        stages.append(("clean_text", alive, alive, F.col("_clean")))
    masking = steps.get("mask_entities", {})
    if _enabled(masking):
        masked = ent.mask_entities(
            F.col(text_col), F.col("entities"), masking.get("entity_types")
        )
        out = out.withColumn("_text2", F.when(alive, masked)).withColumn(
            "_mask", F.coalesce(F.col("_text2") != F.col(text_col), never)
        )
        out = out.withColumn(text_col, F.col("_text2"))
        stages.append(("mask_entities", alive, alive, F.col("_mask")))
    diversity = steps.get("filter_low_lexical_diversity", {})
    if _enabled(diversity):
        least = diversity.get("min_hhd_threshold", diversity.get("min_hdd_threshold", 0.7))
        rich = lexical.hdd(F.col(text_col)) >= least
        out = out.withColumn("_rich", F.when(alive, F.coalesce(rich, never)).otherwise(False))
        stages.append(("filter_low_lexical_diversity", alive, F.col("_rich"), never))
        alive = F.col("_rich")
    flags = [c for c in ("_first", "_fits", "_clean", "_mask", "_rich") if c in out.columns]
    return out.select(*df.columns, *flags), stages, alive


def process_train(df: DataFrame, steps: Mapping) -> tuple[DataFrame, DataFrame]:
    """The processed rows and the step audit, from one evaluation of the steps."""
    check_steps(steps)
    if not any(_enabled(s) for s in steps.values()):
        return df, audit.step_audit(df, [("none", F.lit(True), F.lit(True), F.lit(False))])
    frame, stages, alive = staged(df, steps)
    frame = materialise(frame, "staged")
    return frame.filter(alive).select(*df.columns), audit.step_audit(frame, stages)


def run_recipe(
    df: DataFrame, recipe: Mapping, seed: int = keys.SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Processed train rows, raw test rows and the step audit.

    The split is written once, partitioned by side, before the branches part.
    """
    split = materialise(split_corpus(df, recipe, seed), "split", ["split"])
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    train, steps = process_train(spread(train, "row_id"), recipe.get("processing", {}))
    return train, test, steps


def shared_texts(train: DataFrame, test: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts that occur on both sides of a split; they are reported, not removed."""

    def hashes(df):
        return df.select(keys.text_identity(F.col(text_col)).alias("k")).distinct()

    return hashes(train).join(hashes(test), "k").agg(F.count("*").alias("n_shared_texts"))


def write_recipe(df: DataFrame, recipe: Mapping, folder: str, fmt: str = "csv") -> DataFrame:
    """Run a recipe, write both sides, give back the audit."""
    train, test, steps = run_recipe(df, recipe)
    files.write_split(train, test, folder, fmt)
    return steps
