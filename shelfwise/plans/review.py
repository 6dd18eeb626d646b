"""From a dataset to everything that is shown about it: titles, classes, summaries and candidate lists."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.rules import DEFAULT_RULES, ClassLimits, Rules
from shelfwise.operators import candidates as cand
from shelfwise.operators import summaries
from shelfwise.operators.classify import classify
from shelfwise.operators.discovery import loan_words
from shelfwise.operators.metrics import NO_PREFIX, title_metrics, title_metrics_frame
from shelfwise.operators.windowing import ANY_ACTION, UsagePolicy
from shelfwise.schema import is_title_level
from shelfwise.sources.tables import read_dataset
from shelfwise.staging import stage


def with_window_columns(titles: DataFrame, years: int) -> DataFrame:
    """Label titles with a window length; their figures stay those they were built with."""
    columns = {"okno_let": F.lit(years)}
    if "vypujcky_okno" not in titles.columns and "vypujcky_5_let" in titles.columns:
        columns["vypujcky_okno"] = F.col("vypujcky_5_let")
    return titles.withColumns(columns)


def with_preselected_loans(events: DataFrame, policy: UsagePolicy) -> UsagePolicy:
    """Where neither chosen actions nor flags tell the loans of an uploaded table: action types that are words for loan, else all types."""
    if policy.wanted_actions or "ACTION_TYPE" not in events.columns or {"IS_LOAN", "ACTION_GROUP"} & set(events.columns):
        return policy
    words = loan_words(events)
    return replace(policy, loan_actions=words) if words else replace(policy, loan_policy=ANY_ACTION)


def load_titles(
    spark: SparkSession,
    path: str,
    *,
    policy: UsagePolicy | None = None,
    sign_prefix: str | None = None,
    as_frame: bool = False,
) -> DataFrame:
    """Titles of a dataset: read as they are if it holds titles, else computed from its operations.

    ``as_frame`` applies the rules for uploaded frames; without chosen actions, loans are preselected there.
    """
    policy = policy or UsagePolicy()
    data, _ = read_dataset(spark, path)
    if is_title_level(data):
        wanted = (sign_prefix or NO_PREFIX).strip()
        titles = data if wanted == NO_PREFIX else data.filter(F.col("SIGN_PREFIX").cast("string") == wanted)
    elif as_frame:
        titles = title_metrics_frame(data, policy=with_preselected_loans(data, policy))
    else:
        titles = title_metrics(data, policy=policy, sign_prefix=sign_prefix)
    return with_window_columns(titles, policy.years)


@dataclass(frozen=True)
class Review:
    """The parts of a review; each is a plan of its own over the classified titles."""

    titles: DataFrame
    results: DataFrame
    summary: DataFrame
    kpi: DataFrame
    class_counts: DataFrame
    top_auto: DataFrame
    write_off: DataFrame
    buy: DataFrame
    unclear: DataFrame


def review(
    titles: DataFrame,
    *,
    rules: Rules = DEFAULT_RULES,
    limits: ClassLimits | None = None,
    filters: cand.Filters | None = None,
    focus: str | None = None,
) -> Review:
    """Classify, filter and summarise. The selection is written once, since every part reads it."""
    filters = filters or cand.Filters()
    chosen = cand.apply_filters(classify(titles, rules=rules, limits=limits), filters)
    if focus and focus != NO_PREFIX:
        chosen = summaries.focus_prefix(chosen, focus)
    chosen = stage(chosen, "review")
    summary = summaries.by_prefix(chosen)
    (min_copies, max_copies), (min_use, max_use) = filters.copies_range, filters.use_range
    return Review(
        titles=chosen,
        results=cand.result_table(chosen),
        summary=summary,
        kpi=summaries.kpi(chosen),
        class_counts=summaries.class_counts(chosen),
        top_auto=summaries.top_auto_prefixes(summary),
        write_off=cand.candidate_table(cand.write_off_candidates(chosen, min_copies=min_copies, max_use=max_use)),
        buy=cand.candidate_table(cand.buy_candidates(chosen, max_copies=max_copies, min_use=min_use)),
        unclear=cand.candidate_table(cand.unclear_cases(chosen)),
    )
