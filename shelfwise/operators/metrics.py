"""Metrics per title over a rolling window.

Both inputs, wide enriched operations and the star of operations, copies and titles, are first reduced to a *cube*: one
row per identity and kind of operation with the number of operations inside the window and the latest of them. Its keys and
aggregates are fixed-width numbers, so Spark hashes (and combines before the shuffle) instead of sorting the fact.
Texts are joined afterwards, when there are as many rows as titles: in the wide form from a dictionary of the identities.
What must be known before the cube (end of the window, operation codes) comes from the summary of the operations (``facts``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.calendar import parse_time, years_between
from shelfwise.functions.keys import (
    PREFIX_LENGTH,
    is_ambiguous_key,
    signature_prefix,
    signature_prefix_frame,
    title_key,
)
from shelfwise.functions.labels import OPID_COUNT_PREFIX
from shelfwise.functions.operations import action_type, decode, operation_flags
from shelfwise.functions.scores import (
    loans_per_copy,
    percentile_in_group,
    percentile_in_group_frame,
    position_text,
    risk_score,
)
from shelfwise.operators.copies import copies_per_title, copies_seen_in_events
from shelfwise.operators.discovery import distinct_opids
from shelfwise.operators.events import SOURCE_COLUMNS, clean_events, normalise_events
from shelfwise.operators.facts import KIND_COLUMNS, summary_of
from shelfwise.operators.joins import join_code_list
from shelfwise.operators.ranking import BROADCAST_ROWS, rank_within
from shelfwise.operators.windowing import (
    ALL_OR_NOTHING,
    ANY_ACTION,
    FLAG_FIRST,
    UsagePolicy,
    flag_window,
    loan_predicate,
    window_bounds,
)
from shelfwise.schema import safe_long
from shelfwise.staging import read_once, stage

META = ("doc_type", "lang", "year_pub", "desk_subjects", "och_subjects")
IDENTITY = ("TITUL_KEY", "signature", "title_name", *META)
ID = ("id_1", "id_2")  # 128 bits that stand for an identity
TOTALS = ("pocet_operaci_v_obdobi", "pocet_vypujcek_is_loan", "pocet_vraceni_is_return")
LAST = "datum_posledni_vypujcky"
NO_PREFIX = "(vsechny)"  # fixed value: the choice that means every prefix
PIVOT_COLUMNS = 512  # operation codes that can become columns; all codes are in the long form


def _settled(events: DataFrame, signature_col: str = "TITUL_SIGN_FULL") -> DataFrame:
    """Wide operations that cube, dictionary, summary and copies can each read: not joined anew for each."""
    return read_once(events, (*SOURCE_COLUMNS, *KIND_COLUMNS, signature_col), "operations")


def _usage_cube(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    inside = F.col("in_window")
    return flagged.groupBy(*keys).agg(
        F.count_if(inside).alias("n"),
        F.max(F.when(inside, F.col("dt"))).alias("last_dt"),
    )


def _measures(opids: Sequence[int]) -> list[Column]:
    """Conditional sums over a cube."""
    n = F.col("n")

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)).alias(name)

    out = [
        total(F.col("loan"), "vypujcky_5_let"),
        F.max(F.when(F.col("loan"), F.col("last_dt"))).alias(LAST),
        F.sum("n").alias("pocet_operaci_v_obdobi"),
        total(F.coalesce(F.col("is_loan_flag"), F.lit(False)), "pocet_vypujcek_is_loan"),
        total(F.coalesce(F.col("is_return_flag"), F.lit(False)), "pocet_vraceni_is_return"),
    ]
    return out + [total(F.col("vyp_opid") == k, f"{OPID_COUNT_PREFIX}{k}") for k in opids]


def _count_names(opids: Sequence[int]) -> list[str]:
    return ["vypujcky_5_let", *TOTALS, *[f"{OPID_COUNT_PREFIX}{k}" for k in opids]]


def _merged(opids: Sequence[int]) -> list[Column]:
    """Measures of several identities together."""
    return [*[F.sum(c).alias(c) for c in _count_names(opids)], F.max(LAST).alias(LAST)]


class WideUsage:
    """Usage by identity, from normalised operations.

    An identity (title key, shelf mark, name and metadata) is hashed where the row is read. The cube's keys and values are
    fixed-width numbers; what an identity stands for is in a dictionary of its own, in which every identity must have one spelling.
    """

    def __init__(self, narrow: DataFrame, bounds: DataFrame, policy: UsagePolicy, present: set[str]) -> None:
        # the hash passes over nulls, so they are marked
        parts = [part for c in IDENTITY for part in (F.col(c), F.col(c).isNull())]
        hashed = narrow.withColumns({name: F.xxhash64(F.lit(seed), *parts) for seed, name in enumerate(ID)})
        kinds = {"loan": loan_predicate(policy, present)}
        flagged = flag_window(hashed.withColumns(kinds), bounds, policy)
        self.cube = _usage_cube(flagged, [*ID, "vyp_opid", "loan", "is_loan_flag", "is_return_flag"])
        spelled = hashed.select(*ID, *IDENTITY).distinct()
        self.dictionary = spelled.groupBy(*ID).agg(
            F.count(F.lit(1)).alias("spellings"), *[F.first(c).alias(c) for c in IDENTITY]
        )

    def measures(self, opids: Sequence[int]) -> DataFrame:
        return self.cube.groupBy(*ID).agg(*_measures(opids)).join(self.dictionary, [*ID]).drop(*ID)

    def opid_counts(self) -> DataFrame:
        counts = self.cube.where("vyp_opid IS NOT NULL").groupBy(*ID, "vyp_opid").agg(F.sum("n").alias("n")).where("n > 0")
        return counts.join(self.dictionary, [*ID]).drop(*ID)


def _titles_by_pair(rows: DataFrame, opids: Sequence[int], prefix_length: int) -> DataFrame:
    """One row per (signature, name); a title without a key has no countable operations."""
    counts = _count_names(opids)
    grouped = rows.groupBy("signature", "title_name").agg(
        *_merged(opids), *[F.min(m).alias(m) for m in ("TITUL_KEY", *META)], F.max("spellings").alias("spellings")
    )
    signature, name = F.col("signature"), F.col("title_name")
    keyed = grouped.withColumns(
        {
            "title_key": title_key(signature, name),
            "SIGN_PREFIX": signature_prefix(signature, prefix_length),
            "_shared": is_ambiguous_key(signature, name),
        }
    )
    has_key = F.col("title_key").isNotNull()
    return keyed.withColumns(
        {
            **{c: F.when(has_key, F.col(c)).otherwise(F.lit(0).cast("bigint")) for c in counts},
            LAST: F.when(has_key, F.col(LAST)),
        }
    )


def _share_counts(titles: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Give pairs that spell the same key the counts of all of them; rows whose key has one spelling pass unchanged."""
    measures = [*counts, LAST]
    shared = titles.filter("_shared")
    per_key = shared.groupBy("title_key").agg(*[F.sum(c).alias(c) for c in counts], F.max(LAST).alias(LAST))
    fixed = shared.drop(*measures).join(per_key, "title_key", "left")
    return titles.filter("NOT _shared").unionByName(fixed)


def _finish(
    titles: DataFrame,
    copies: DataFrame,
    bounds: DataFrame,
    policy: UsagePolicy,
    opids: Sequence[int],
    *,
    frame: bool = False,
    sign_prefix: str | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Copies, rank within the prefix and everything derived from them."""
    joined = titles.join(copies, "TITUL_KEY", "left").withColumns(
        {
            "pocet_svazku": F.coalesce(F.col("pocet_svazku"), F.lit(0).cast("bigint")),
            "reference_end": bounds.scalar()["end_dt"],
        }
    )
    staged = stage(joined, "titles")
    facts = staged.agg(
        F.count("*").alias("rows"), F.count_if("_shared").alias("shared"), F.max("spellings").alias("spellings")
    ).first()
    if (facts["spellings"] or 1) > 1:
        raise RuntimeError("two identities of titles share a 128-bit hash")
    if facts["shared"]:
        staged = _share_counts(staged, _count_names(opids))
    if sign_prefix:
        staged = staged.filter(F.col("SIGN_PREFIX") == sign_prefix)
    ranked = rank_within(
        staged,
        group="SIGN_PREFIX",
        measure="vypujcky_5_let",
        spread_by=["title_key", "TITUL_KEY"],
        max_broadcast_rows=max_broadcast_rows,
        rows_bound=facts["rows"],
    )
    rank, size = F.col("rank_v_signature"), F.col("pocet_v_signature")
    loans, held = F.col("vypujcky_5_let"), F.col("pocet_svazku")
    percentile = percentile_in_group_frame(rank, size) if frame else percentile_in_group(rank, size)
    # Whole 24-hour periods in the frame variant, calendar days otherwise.
    since = years_between(F.col("datum_posledni_vypujcky"), F.col("reference_end"))
    if frame:
        days = F.extract(F.lit("DAY"), F.col("reference_end") - F.col("datum_posledni_vypujcky"))
        since = F.round(days / F.lit(365.25), 2)
    base = ranked.withColumns(
        {
            "vykon_na_svazek": loans_per_copy(loans, held),
            "percentil_v_signature": percentile,
            "relativni_pozice_v_signature": position_text(rank, size),
            "roky_od_posledni_vypujcky": since,
        }
    )
    return base.select(
        "title_key",
        "TITUL_KEY",
        F.col("signature").alias("TITUL_SIGN_FULL"),
        "SIGN_PREFIX",
        F.col("title_name").alias("TITUL_NAZEV"),
        F.col("doc_type").alias("TITUL_DRUH_DOKUMENTU"),
        F.col("lang").alias("TITUL_JAZYK"),
        F.col("year_pub").alias("TITUL_ROK_VYDANI"),
        "desk_subjects",
        "och_subjects",
        *TOTALS,
        *[f"{OPID_COUNT_PREFIX}{k}" for k in opids],
        "vypujcky_5_let",
        "pocet_svazku",
        "vykon_na_svazek",
        "datum_posledni_vypujcky",
        "rank_v_signature",
        "pocet_v_signature",
        "percentil_v_signature",
        "relativni_pozice_v_signature",
        "roky_od_posledni_vypujcky",
        F.lit(policy.years).alias("okno_let"),
        loans.alias("vypujcky_okno"),
        (loans == 0).alias("bez_vypujcek"),
        (held == 0).alias("bez_svazku"),
        risk_score(loans, F.col("percentil_v_signature"), F.col("roky_od_posledni_vypujcky")).alias("rizikove_skore"),
    )


def _wanted_prefix(prefix: str | None) -> str | None:
    prefix = (prefix or "").strip()
    return prefix.upper() if prefix and prefix != NO_PREFIX else None


def _pivot_codes(summary: DataFrame, opids: Sequence[int] | None, max_opids: int | None) -> list[int]:
    """The caller's list, or the codes of a summary, which must be few enough for columns (or the first ``max_opids`` of them)."""
    if opids is not None:
        return list(opids)
    codes = distinct_opids(summary, max_opids=PIVOT_COLUMNS + 1 if max_opids is None else max_opids)
    found = [r["opid"] for r in codes.take(PIVOT_COLUMNS + 1)]
    if len(found) > PIVOT_COLUMNS:
        raise ValueError(f"more than {PIVOT_COLUMNS} operation codes: name those to count in columns, or use the long form")
    return found


def _wanted_rows(narrow: DataFrame, prefix: str | None, prefix_length: int) -> DataFrame:
    """Rows of a prefix, and those whose key another title may share."""
    if not prefix:
        return narrow
    signature, name = F.col("signature"), F.col("title_name")
    same = signature_prefix(signature, prefix_length) == prefix
    return narrow.filter(same | is_ambiguous_key(signature, name))


def title_metrics(
    events: DataFrame,
    *,
    copies: DataFrame | None = None,
    policy: UsagePolicy | None = None,
    sign_prefix: str | None = None,
    opids: Sequence[int] | None = None,
    max_opids: int | None = None,
    signature_col: str = "TITUL_SIGN_FULL",
    prefix_length: int = PREFIX_LENGTH,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Metrics of every title found in wide enriched operations. ``summary`` is that of the operations, if it is written beside them."""
    policy = policy or UsagePolicy()
    present = set(events.columns)
    events = _settled(events, signature_col)
    summary = summary_of(events, summary)
    opids = _pivot_codes(summary, opids, max_opids)
    narrow = normalise_events(events, signature_col=signature_col)
    prefix = _wanted_prefix(sign_prefix)
    bounds = window_bounds(normalise_events(summary), policy)
    usage = WideUsage(_wanted_rows(narrow, prefix, prefix_length), bounds, policy, present)
    titles = _titles_by_pair(usage.measures(opids), opids, prefix_length)
    held = copies_per_title(copies) if copies is not None else copies_seen_in_events(narrow)
    return _finish(titles, held, bounds, policy, opids, sign_prefix=prefix)


def _counts_by_key(rows: DataFrame) -> DataFrame:
    """(``title_key``, ``opid``, ``n``) from counts by signature and name; titles without a key have no countable operations.

    The key's text is looked up once per title: counts are summed by its hash."""
    key = title_key(F.col("signature"), F.col("title_name"))
    keyed = rows.withColumn("title_key", key).where("title_key IS NOT NULL")
    hashed = keyed.select("title_key", "vyp_opid", "n", *[F.xxhash64(F.lit(seed), "title_key").alias(name) for seed, name in enumerate(ID)])
    spelled = hashed.select(*ID, "title_key").distinct()
    return (
        hashed.groupBy(*ID, "vyp_opid").agg(F.sum("n").alias("n")).join(spelled, [*ID]).select("title_key", F.col("vyp_opid").alias("opid"), "n")
    )


def opid_counts(
    events: DataFrame, *, policy: UsagePolicy | None = None, signature_col: str = "TITUL_SIGN_FULL", summary: DataFrame | None = None
) -> DataFrame:
    """Operations inside the window by title and operation code, one row for each pair that occurs; any number of codes."""
    policy = policy or UsagePolicy()
    present = set(events.columns)
    events = _settled(events, signature_col)
    bounds = window_bounds(normalise_events(summary_of(events, summary)), policy)
    narrow = normalise_events(events, signature_col=signature_col)
    return _counts_by_key(WideUsage(narrow, bounds, policy, present).opid_counts())


def with_opid_counts(titles: DataFrame, counts: DataFrame, opids: Sequence[int]) -> DataFrame:
    """Titles with a column for each of the given codes, from counts in long form; columns of that name are replaced."""
    names = [f"{OPID_COUNT_PREFIX}{k}" for k in opids]
    sums = [F.sum(F.when(F.col("opid") == k, F.col("n")).otherwise(0)).alias(c) for k, c in zip(opids, names, strict=True)]
    if not sums:
        return titles
    wide = counts.where(F.col("opid").isin(*opids)).groupBy("title_key").agg(*sums)
    zero = F.lit(0).cast("bigint")
    return titles.drop(*names).join(wide, "title_key", "left").withColumns({c: F.coalesce(F.col(c), zero) for c in names})


class StarUsage:
    """Usage by title from operations, copies and titles: operations are reduced by copy and code, the dimensions joined afterwards.

    Every measure is a sum or a maximum, so a dimension that repeats a key multiplies counts exactly as it would in the wide table.
    """

    def __init__(
        self,
        operations: DataFrame,
        copies: DataFrame,
        op_types: DataFrame,
        policy: UsagePolicy,
        summary: DataFrame | None,
    ) -> None:
        ops = operations.select(
            safe_long(operations, "STAT_VYP_PTR_SVAZKY").alias("copy_key"),
            safe_long(operations, "STAT_VYP_OPID").alias("vyp_opid"),
            F.to_date(parse_time(operations, "STAT_VYP_TIME")).cast("timestamp_ntz").alias("dt"),
        ).withColumn("yr", F.year("dt"))
        raw = ops.select(F.col("vyp_opid").alias("VYP_OPID"), F.col("dt").alias("DATE"), F.col("yr").alias("YEAR"))
        self.summary = summary_of(raw, summary)
        self.bounds = window_bounds(normalise_events(self.summary), policy)
        by_copy = _usage_cube(flag_window(ops, self.bounds, policy), ["copy_key", "vyp_opid"])
        owner = copies.select(
            safe_long(copies, "SVAZKY_KEY").alias("copy_key"), safe_long(copies, "SVAZKY_PTR_TITUL").alias("TITUL_KEY")
        )
        types = op_types.select(
            safe_long(op_types, "OPIDY_OPID").alias("vyp_opid"), F.col("OPIDY_POPIS").cast("string").alias("popis")
        )
        flags = operation_flags(F.col("vyp_opid"))
        kinds = {
            "action_type": F.lower(F.trim(action_type(F.col("popis"), F.col("vyp_opid")))),
            "action_group": flags["ACTION_GROUP"],
            "is_loan_flag": flags["IS_LOAN"],
            "is_return_flag": flags["IS_RETURN"],
        }
        owned = by_copy.join(owner, "copy_key", "left").drop("copy_key")
        self.cube = join_code_list(owned, types, "vyp_opid").withColumns(kinds).withColumn(
            "loan", loan_predicate(policy, {"IS_LOAN", "ACTION_GROUP", "ACTION_TYPE"})
        )

    def measures(self, opids: Sequence[int]) -> DataFrame:
        return self.cube.groupBy("TITUL_KEY").agg(*_measures(opids))

    def opid_counts(self) -> DataFrame:
        counts = self.cube.where("vyp_opid IS NOT NULL").groupBy("TITUL_KEY", "vyp_opid")
        return counts.agg(F.sum("n").alias("n")).where("n > 0")


def _described(titles: DataFrame, doc_types: DataFrame | None) -> DataFrame:
    """Titles with the names that normalised operations use."""
    doc_type = F.col("TITUL_DRUH_DOKUMENTU").cast("string")
    described = titles.select(
        safe_long(titles, "TITUL_KEY").alias("TITUL_KEY"),
        F.col("TITUL_SIGN_FULL").cast("string").alias("signature"),
        F.col("TITUL_NAZEV").cast("string").alias("title_name"),
        doc_type.alias("doc_type"),
        F.col("TITUL_JAZYK").cast("string").alias("lang"),
        safe_long(titles, "TITUL_ROK_VYDANI").cast("double").alias("year_pub"),
    )
    if doc_types is None:
        return described
    labels = doc_types.select(F.col("CISELNIKY_ZKRATKA").alias("doc_type"), F.col("CISELNIKY_TEXT").alias("doc_label"))
    decoded = join_code_list(described, labels, "doc_type")
    return decoded.withColumn("doc_type", decode(F.col("doc_label"), F.col("doc_type"))).drop("doc_label")


def title_metrics_from_star(
    operations: DataFrame,
    copies: DataFrame,
    titles: DataFrame,
    op_types: DataFrame,
    *,
    doc_types: DataFrame | None = None,
    subjects: DataFrame | None = None,
    policy: UsagePolicy | None = None,
    sign_prefix: str | None = None,
    opids: Sequence[int] | None = None,
    max_opids: int | None = None,
    prefix_length: int = PREFIX_LENGTH,
    summary: DataFrame | None = None,
) -> DataFrame:
    """The same metrics without building the wide operations first: texts are joined to one row per title."""
    policy = policy or UsagePolicy()
    usage = StarUsage(operations, copies, op_types, policy, summary)
    opids = _pivot_codes(usage.summary, opids, max_opids)
    prefix = _wanted_prefix(sign_prefix)
    described = _wanted_rows(_described(titles, doc_types), prefix, prefix_length)
    rows = usage.measures(opids).join(described, "TITUL_KEY", "inner" if prefix else "left")
    nothing = F.lit(None).cast("string")
    if subjects is not None:
        rows = rows.join(subjects.select("TITUL_KEY", "desk_subjects", "och_subjects"), "TITUL_KEY", "left")
    else:
        rows = rows.withColumns({"desk_subjects": nothing, "och_subjects": nothing})
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("desk_subjects", "och_subjects")}
    rows = rows.withColumns({**texts, "spellings": F.lit(1)})
    by_pair = _titles_by_pair(rows, opids, prefix_length)
    return _finish(by_pair, copies_per_title(copies), usage.bounds, policy, opids, sign_prefix=prefix)


def opid_counts_from_star(
    operations: DataFrame,
    copies: DataFrame,
    titles: DataFrame,
    op_types: DataFrame,
    *,
    policy: UsagePolicy | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """``opid_counts`` from the star tables."""
    usage = StarUsage(operations, copies, op_types, policy or UsagePolicy(), summary)
    return _counts_by_key(usage.opid_counts().join(_described(titles, None), "TITUL_KEY", "left"))


def title_metrics_frame(
    events: DataFrame,
    *,
    policy: UsagePolicy | None = None,
    opids: Sequence[int] | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Variant for uploaded frames: cleaned input, NULL key parts as empty, one record per key, copies from the rows.

    Dates are all-or-nothing, a loan flag wins over the chosen actions, and every operation code gets a column.
    """
    policy = policy or UsagePolicy()
    loans = ANY_ACTION if policy.loan_policy == ANY_ACTION else FLAG_FIRST
    policy = UsagePolicy(policy.years, policy.loan_actions, ALL_OR_NOTHING, loans, policy.now)
    present = set(events.columns)
    cleaned = clean_events(_settled(events))
    summary = summary_of(cleaned, summary)
    opids = _pivot_codes(summary, opids, None)
    narrow = normalise_events(cleaned).withColumns(
        {
            "signature": F.coalesce("signature", F.lit("")),
            "title_name": F.coalesce("title_name", F.lit("")),
        }
    )
    bounds = window_bounds(normalise_events(summary), policy)
    usage = WideUsage(narrow, bounds, policy, present)
    record = ["signature", "title_name", *META, "TITUL_KEY"]
    titles = (
        usage.measures(opids)
        .withColumn("title_key", title_key(F.col("signature"), F.col("title_name"), null_as_empty=True))
        .groupBy("title_key")
        .agg(*_merged(opids), F.max("spellings").alias("spellings"), F.min(F.struct(*record)).alias("record"))
        .select("*", "record.*")
        .drop("record")
        .withColumns({"SIGN_PREFIX": signature_prefix_frame(F.col("signature")), "_shared": F.lit(False)})
    )
    if {"SVAZKY_KEY", "TITUL_KEY"} <= present:
        held = copies_seen_in_events(narrow)
    else:
        held = titles.sparkSession.createDataFrame([], "TITUL_KEY bigint, pocet_svazku bigint")
    return _finish(titles, held, bounds, policy, opids, frame=True)
