"""Every registered query: a function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.labels import class_label, labelled, labelled_prefixes, labelled_summary
from shelfwise.functions.rules import AUTO, CLASSES, ClassLimits
from shelfwise.operators import candidates as cand
from shelfwise.operators import discovery, facts, metrics, rollup, summaries
from shelfwise.operators.classify import classify, flag_exceptions, rules_from_json
from shelfwise.operators.copies import copies_per_title
from shelfwise.operators.enrich import assemble_titles, decode_doc_types, enrich_from_dimensions, enrich_operations, reader_demographics
from shelfwise.operators.events import clean_events
from shelfwise.operators.quality import validate_build
from shelfwise.operators.subjects import title_subjects
from shelfwise.operators.windowing import UsagePolicy, filter_window
from shelfwise.plans.catalog import loans_by_title_view, register_views, save_dimensions, save_star
from shelfwise.plans.ingest import table_path
from shelfwise.plans.rebuild import rebuild_all
from shelfwise.plans.review import load_titles, review
from shelfwise.sinks.tables import export_by_class, write_csv, write_parquet
from shelfwise.sources.charset import decode_bytes
from shelfwise.sources.dumps import convert_to_utf8, raw_lines, read_dump
from shelfwise.staging import new_stage_path
from workload.dump_writer import encode_windows_1250, file_count, write_dump
from workload.roles import Roles

LOAN_ACTIONS = ("loan out", "loan in house")
OPIDS = (4, 5, 7, 8, 97, 98)
POLICY = UsagePolicy(years=2, loan_actions=LOAN_ACTIONS)
RULES = {"TITUL_NAZEV": ["red"]}
LIMITS = ClassLimits(low_loans_min=1, low_loans_max=2, bottom_percentile=30.0, stale_years=1.0, auto_max_loans=3)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the name of the function, without the underscore that keeps it apart from an operator."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def portable(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that engines can be compared."""
    return df.select(
        *[
            F.col(f.name).cast("string").alias(f.name)
            if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def star_metrics(r: Roles, *, subjects: bool = False, **options) -> DataFrame:
    return metrics.title_metrics_from_star(
        r.operations(),
        r.copies(),
        r.titles(),
        r.op_types(),
        doc_types=r.doc_types(),
        subjects=title_subjects(**r.subject_tables()) if subjects else None,
        policy=POLICY,
        **options,
    )


def classified(r: Roles, **options) -> DataFrame:
    return classify(star_metrics(r, **options), rules=RULES, limits=LIMITS)


# --- metrics -----------------------------------------------------------------------------------------------------


@query
def title_metrics(spark, sf_dir):
    return portable(star_metrics(Roles(spark, sf_dir), opids=[]))


@query
def title_metrics_opid_pivot(spark, sf_dir):
    df = star_metrics(Roles(spark, sf_dir), opids=OPIDS)
    counts = sorted(c for c in df.columns if c.startswith("pocet_opid_"))
    return df.select("title_key", *metrics.TOTALS, *counts)


@query
def opid_counts_long(spark, sf_dir):
    """Operations by title and code, a row for each pair that occurs."""
    r = Roles(spark, sf_dir)
    return metrics.opid_counts_from_star(r.operations(), r.copies(), r.titles(), r.op_types(), policy=POLICY)


@query
def opid_counts_wide(spark, sf_dir):
    return metrics.opid_counts(Roles(spark, sf_dir).enriched(), policy=POLICY)


@query
def titles_with_opid_counts(spark, sf_dir):
    """Chosen codes as columns, one of which no operation has."""
    r = Roles(spark, sf_dir)
    counts = metrics.opid_counts(r.enriched(), policy=POLICY)
    return metrics.with_opid_counts(star_metrics(r, opids=[]).select("title_key"), counts, [97, 8, 12345])


@query
def title_metrics_wide(spark, sf_dir):
    r = Roles(spark, sf_dir)
    return portable(metrics.title_metrics(r.enriched(), copies=r.copies(), policy=POLICY, opids=[]))


@query
def title_metrics_flags(spark, sf_dir):
    """No chosen actions: the loan flag or group decides; copies are those seen in the operations."""
    r = Roles(spark, sf_dir)
    df = metrics.title_metrics(r.enriched(), policy=UsagePolicy(years=3), opids=[])
    return portable(df.select("title_key", "vypujcky_5_let", "pocet_svazku", "vykon_na_svazek", "rizikove_skore"))


@query
def title_metrics_frame(spark, sf_dir):
    return portable(metrics.title_metrics_frame(Roles(spark, sf_dir).enriched(), policy=POLICY))


@query
def title_metrics_wide_subjects(spark, sf_dir):
    """Wide operations with the subject texts of their titles."""
    r = Roles(spark, sf_dir)
    events = _enriched_with_everything(r)
    return portable(metrics.title_metrics(events, copies=r.copies(), policy=POLICY, opids=[]))


@query
def title_metrics_frame_subjects(spark, sf_dir):
    return portable(metrics.title_metrics_frame(_enriched_with_everything(Roles(spark, sf_dir)), policy=POLICY, opids=[4, 98]))


@query
def title_metrics_upload(spark, sf_dir):
    """An uploaded table without flags, whose loans are known by a word for them."""
    events, path = Roles(spark, sf_dir).enriched(), new_stage_path(spark, "upload")
    kind = F.when(F.col("IS_LOAN"), F.lit(" Checkout")).otherwise(F.col("ACTION_TYPE"))
    write_parquet(events.withColumn("ACTION_TYPE", kind).drop("IS_LOAN", "ACTION_GROUP"), path)
    titles = load_titles(spark, path, policy=UsagePolicy(years=2), as_frame=True)
    return titles.select("title_key", "vypujcky_5_let", "vypujcky_okno", "pocet_svazku", "okno_let")


@query
def metrics_one_prefix(spark, sf_dir):
    df = star_metrics(Roles(spark, sf_dir), sign_prefix="pr", opids=[])
    return df.select("title_key", "SIGN_PREFIX", "vypujcky_5_let", "rank_v_signature", "pocet_v_signature")


@query
def risk_score(spark, sf_dir):
    return star_metrics(Roles(spark, sf_dir), opids=[]).select(
        "title_key", "bez_vypujcek", "bez_svazku", "rizikove_skore"
    )


@query
def window_filter(spark, sf_dir):
    rows = filter_window(Roles(spark, sf_dir).enriched(), POLICY, loans_only=True)
    return rows.groupBy("ACTION_TYPE", "YEAR").agg(F.count("*").alias("n"))


@query
def cleaned_events(spark, sf_dir):
    """Frame cleaning over operations whose dates are day-first text."""
    raw = Roles(spark, sf_dir).enriched().withColumns(
        {
            "DATE": F.date_format("DATE", "d.M.yyyy"),
            "ACTION_TYPE": F.concat(F.lit(" "), F.upper("ACTION_TYPE"), F.lit("\t")),
            "TITUL_NAZEV": F.concat(F.lit("\t"), "TITUL_NAZEV", F.lit(" ")),
        }
    )
    out = clean_events(raw.drop("YEAR", "desk_subjects"))
    grouped = out.groupBy("TITUL_NAZEV", "ACTION_TYPE", F.col("YEAR").cast("int").alias("YEAR"), "desk_subjects")
    return portable(grouped.agg(F.count("*").alias("n"), F.min("DATE").alias("first"), F.max("DATE").alias("last")))


# --- discovery ---------------------------------------------------------------------------------------------------


@query
def action_types(spark, sf_dir):
    return discovery.action_types(Roles(spark, sf_dir).enriched())


@query
def suggested_loan_actions(spark, sf_dir):
    return discovery.suggested_loan_actions(Roles(spark, sf_dir).enriched())


@query
def distinct_opids(spark, sf_dir):
    return discovery.distinct_opids(Roles(spark, sf_dir).enriched())


@query
def operations_summary(spark, sf_dir):
    """Kinds of operation with rows and greatest date: the summaries of the years, written as parts and merged."""
    path = new_stage_path(spark, "summary")
    facts.write_summary(Roles(spark, sf_dir).enriched(), path, by="YEAR")
    return portable(facts.read_summary(spark, path)).withColumnRenamed("rows", "n")


@query
def opid_legend(spark, sf_dir):
    return discovery.opid_legend(Roles(spark, sf_dir).enriched())


@query
def opid_labels(spark, sf_dir):
    return discovery.opid_labels(discovery.opid_legend(Roles(spark, sf_dir).enriched()))


@query
def prefix_summary(spark, sf_dir):
    return discovery.prefix_summary(Roles(spark, sf_dir).enriched())


@query
def prefix_summary_of_titles(spark, sf_dir):
    return labelled_prefixes(discovery.prefix_summary_of_titles(star_metrics(Roles(spark, sf_dir), opids=[])))


@query
def copies_per_title_(spark, sf_dir):
    return copies_per_title(Roles(spark, sf_dir).copies())


@query
def loans_by_title(spark, sf_dir):
    return portable(loans_by_title_view(Roles(spark, sf_dir).enriched(), loan_column="ACTION_GROUP"))


@query
def star_schema_views(spark, sf_dir):
    """The five tables written, and both views by title; the loans view in its form by action type and in that by group."""
    r = Roles(spark, sf_dir)
    path = new_stage_path(spark, "star")
    save_star(spark, r.enriched(), r.titles(), r.copies(), r.branches(), r.op_types(), path=path)
    register_views(spark)
    by_type = spark.table("v_loans_by_titul").withColumnRenamed("loan_cnt", "loan_type_cnt")
    register_views(spark, loan_column="ACTION_GROUP")
    by_group = spark.table("v_loans_by_titul").select("TITUL_KEY", "loan_cnt")
    views = spark.table("v_titul_svazky").join(by_type, "TITUL_KEY", "full").join(by_group, "TITUL_KEY", "full")
    return portable(views)


@query
def count_labels(spark, sf_dir):
    """The operation counts offered as filters, with their labels and greatest values."""
    return cand.count_filter_labels(star_metrics(Roles(spark, sf_dir), opids=[]))


# --- classification ----------------------------------------------------------------------------------------------


@query
def classify_titles(spark, sf_dir):
    df = classified(Roles(spark, sf_dir), opids=[])
    return df.select("title_key", "vyjimka_flag", "klasifikace", "duvod_oznaceni")


@query
def classify_titles_zero_limit(spark, sf_dir):
    """Default limits: nothing is automatic, because a title without loans counts as stale."""
    df = classify(star_metrics(Roles(spark, sf_dir), opids=[]), rules=RULES)
    return df.groupBy("klasifikace", "duvod_oznaceni").agg(F.count("*").alias("n"))


@query
def exception_flags(spark, sf_dir):
    """Rules on the titles themselves, with a regular expression and a column that does not exist."""
    rules = {"TITUL_NAZEV": ["^small", "blue "], "TITUL_SIGN_FULL": ["PROMO"], "nothing": ["x"]}
    flagged = flag_exceptions(Roles(spark, sf_dir).titles(), rules)
    return flagged.select("TITUL_KEY", "vyjimka_flag")


@query
def exception_flags_from_table(spark, sf_dir):
    """Rules kept as JSON texts, one for each brand: the shelf marks of its small parts (which begin other marks), names of its large ones, a pattern."""
    r = Roles(spark, sf_dir)
    part = r.table("part")
    mark = F.concat_ws(" ", F.upper("p_type"), F.col("p_partkey").cast("string"))
    lists = part.groupBy("p_brand").agg(
        F.collect_set(F.when(F.col("p_size") <= 2, mark)).alias("TITUL_SIGN_FULL"),
        F.collect_set(F.when(F.col("p_size") == 50, F.substring("p_name", 2, 9))).alias("TITUL_NAZEV"),
        F.array(F.lit("^brand#5[12]$"), F.lit(" ")).alias("TITUL_JAZYK"),
    )
    rules = rules_from_json(lists.select(F.to_json(F.struct("TITUL_SIGN_FULL", "TITUL_NAZEV", "TITUL_JAZYK")).alias("rules")), "rules")
    flagged = flag_exceptions(r.titles(), rules)
    return flagged.select("TITUL_KEY", "vyjimka_flag")


@query
def exception_reasons(spark, sf_dir):
    """Reasons of protected titles; a document type of the fixed keyword list is put in for two of the types."""
    r = Roles(spark, sf_dir)
    doc = F.col("TITUL_DRUH_DOKUMENTU")
    typed = F.when(doc == "type economy", "Beletrie").when(doc == "STANDARD", "poezie a drama").otherwise(doc)
    titles = star_metrics(r, opids=[]).withColumn("TITUL_DRUH_DOKUMENTU", typed)
    df = classify(titles, rules=RULES, limits=LIMITS).filter("vyjimka_flag")
    return df.groupBy("TITUL_DRUH_DOKUMENTU", "duvod_oznaceni").agg(F.count("*").alias("n"))


@query
def rules_table(spark, sf_dir):
    """Rules kept as JSON texts: one text per brand with the names of its titles, one entry that is no list."""
    part = Roles(spark, sf_dir).table("part")
    words = part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("words"))
    texts = words.select(
        F.to_json(
            F.struct(
                F.col("words").alias("TITUL_NAZEV"),
                F.array("p_brand").alias("TITUL_JAZYK"),
                F.lit("no list").alias("TITUL_KEY"),
            )
        ).alias("text")
    )
    return rules_from_json(texts, "text")


# --- summaries ---------------------------------------------------------------------------------------------------


@query
def summary_by_prefix(spark, sf_dir):
    return summaries.by_prefix(classified(Roles(spark, sf_dir), opids=[]))


@query
def summary_by_prefix_rolled(spark, sf_dir):
    """The summary from the cube of titles."""
    return rollup.by_prefix(rollup.title_cube(classified(Roles(spark, sf_dir), opids=[])))


@query
def kpi_rolled(spark, sf_dir):
    df = rollup.kpi(rollup.title_cube(classified(Roles(spark, sf_dir), opids=[])))
    return rounded(df, "prum_vykon", *[f"podil_{c}" for c in CLASSES])


@query
def titles_by_class_rolled(spark, sf_dir):
    """Distinct titles of each class, rolled up over prefixes."""
    cube = rollup.title_cube(classified(Roles(spark, sf_dir), opids=[]))
    return rollup.roll_up(cube, "klasifikace").select("klasifikace", "titles", "rows")


@query
def summary_labelled(spark, sf_dir):
    df = summaries.focus_prefix(classified(Roles(spark, sf_dir), opids=[]), "ST")
    return labelled_summary(summaries.by_prefix(df))


@query
def top_auto_prefixes(spark, sf_dir):
    return summaries.top_auto_prefixes(summaries.by_prefix(classified(Roles(spark, sf_dir), opids=[])))


@query
def kpi_summary(spark, sf_dir):
    df = summaries.kpi(classified(Roles(spark, sf_dir), opids=[]))
    return rounded(df, "prum_vykon", *[f"podil_{c}" for c in CLASSES])


@query
def class_counts(spark, sf_dir):
    counts = summaries.class_counts(classified(Roles(spark, sf_dir), opids=[]))
    return counts.select(class_label(F.col("klasifikace")).alias("popisek"), "pocet")


@query
def facet_values(spark, sf_dir):
    return summaries.facet_values(classified(Roles(spark, sf_dir), opids=[]))


@query
def loan_histogram(spark, sf_dir):
    return summaries.loan_histogram(star_metrics(Roles(spark, sf_dir), opids=[]))


@query
def count_filter_bounds(spark, sf_dir):
    df = star_metrics(Roles(spark, sf_dir), opids=[])
    greatest, cap = cand.count_filter_bounds(df, "pocet_operaci_v_obdobi")
    return spark.range(1).select(F.lit(greatest).alias("greatest"), F.lit(cap).alias("cap"))


# --- candidates --------------------------------------------------------------------------------------------------


@query
def top_writeoff(spark, sf_dir):
    df = cand.write_off_candidates(classified(Roles(spark, sf_dir), opids=[]))
    return df.select("title_key", *cand.CANDIDATE_COLUMNS, "skore_odpis")


@query
def top_buy(spark, sf_dir):
    df = cand.buy_candidates(classified(Roles(spark, sf_dir), opids=[]))
    return df.select("title_key", *cand.CANDIDATE_COLUMNS, "skore_dokup")


@query
def unclear_cases(spark, sf_dir):
    df = cand.unclear_cases(classified(Roles(spark, sf_dir), opids=[]))
    return df.select("title_key", *cand.candidate_table(df).columns)


@query
def quantile_thresholds(spark, sf_dir):
    ranges = cand.recommended_ranges(classified(Roles(spark, sf_dir), opids=[]))
    return spark.range(1).select(
        F.lit(ranges.copies_high).alias("copies_high"),
        F.round(F.lit(ranges.use_low), 9).alias("use_low"),
        F.lit(ranges.copies_low).alias("copies_low"),
        F.round(F.lit(ranges.use_high), 9).alias("use_high"),
        F.lit(ranges.max_copies).alias("max_copies"),
        F.round(F.lit(ranges.max_use), 9).alias("max_use"),
    )


@query
def recommended_writeoff(spark, sf_dir):
    df = classified(Roles(spark, sf_dir), opids=[])
    chosen = cand.apply_filters(df, cand.Filters(**cand.recommended_ranges(df).write_off))
    return cand.write_off_candidates(chosen).select("title_key", "pocet_svazku", "vykon_na_svazek", "skore_odpis")


@query
def recommended_buy(spark, sf_dir):
    df = classified(Roles(spark, sf_dir), opids=[])
    chosen = cand.apply_filters(df, cand.Filters(**cand.recommended_ranges(df).buy))
    return cand.buy_candidates(chosen).select("title_key", "pocet_svazku", "vykon_na_svazek", "skore_dokup")


@query
def filtered_titles(spark, sf_dir):
    df = classified(Roles(spark, sf_dir))
    filters = cand.Filters(
        prefixes=["EC", "PR", "ST"],
        languages=[f"Brand#{i}" for i in range(1, 16)],
        classes=CLASSES[:2] + CLASSES[3:],
        name="(small|large|green)",
        count_column="pocet_opid_4",
        count_range=(0, 2),
        copies_range=(5, 60),
        use_range=(0.0, 0.3),
    )
    return cand.apply_filters(df, filters).select("title_key", "klasifikace", "pocet_opid_4", "pocet_svazku")


@query
def review_of_written_titles(spark, sf_dir):
    """Title metrics written as a dataset, opened for one prefix with another window length, and reviewed."""
    path = new_stage_path(spark, "written-titles")
    write_parquet(star_metrics(Roles(spark, sf_dir), opids=[]), path)
    titles = load_titles(spark, path, policy=UsagePolicy(years=7), sign_prefix="PR")
    parts = review(titles, rules=RULES, limits=LIMITS, filters=cand.Filters(copies_range=(5, None)))
    return parts.results.select("TITUL_KEY", "okno_let", "vypujcky_okno", "klasifikace", "duvod_oznaceni")


def _review(spark, sf_dir):
    path = new_stage_path(spark, "written-titles")
    write_parquet(star_metrics(Roles(spark, sf_dir), opids=[]), path)
    titles = load_titles(spark, path, sign_prefix="PR")
    return review(titles, rules=RULES, limits=LIMITS, filters=cand.Filters(copies_range=(5, None)))


@query
def review_titles(spark, sf_dir):
    return _review(spark, sf_dir).titles.select("title_key", "klasifikace", "duvod_oznaceni", "vyjimka_flag")


@query
def review_summary(spark, sf_dir):
    return _review(spark, sf_dir).summary


@query
def review_kpi(spark, sf_dir):
    return rounded(_review(spark, sf_dir).kpi, "prum_vykon", *[f"podil_{c}" for c in CLASSES])


@query
def review_class_counts(spark, sf_dir):
    return _review(spark, sf_dir).class_counts


@query
def review_top_auto(spark, sf_dir):
    return _review(spark, sf_dir).top_auto


@query
def review_write_off(spark, sf_dir):
    return _review(spark, sf_dir).write_off


@query
def review_buy(spark, sf_dir):
    return _review(spark, sf_dir).buy


@query
def review_unclear(spark, sf_dir):
    return _review(spark, sf_dir).unclear


@query
def labelled_results(spark, sf_dir):
    return labelled(portable(cand.result_table(classified(Roles(spark, sf_dir), subjects=True))))


# --- subjects ----------------------------------------------------------------------------------------------------


@query
def title_subjects_(spark, sf_dir):
    return title_subjects(**Roles(spark, sf_dir).subject_tables())


@query
def subject_variants(spark, sf_dir):
    """Descriptors reached directly, through a table between, and from text kept with the link."""
    r = Roles(spark, sf_dir)
    desk = r.desk().withColumn("DESK_TEXT", F.concat(F.lit(" inline "), F.col("DESK_PTR_TXDESK").cast("string")))
    deskt = r.txdesk().select(F.col("TXDESK_KEY").alias("DESKT_KEY"))
    region = F.concat(F.lit("via "), "TXDESK_DESKRIPTOR")
    txdesk = r.txdesk().select(F.col("TXDESK_KEY").alias("PTR_DESKT"), region.alias("TXDESK_TEXT"))
    return title_subjects(desk=desk, deskt=deskt, txdesk=txdesk)


@query
def subject_search(spark, sf_dir):
    df = classified(Roles(spark, sf_dir), subjects=True, opids=[])
    filters = cand.Filters(desk_terms=["NATION_1$", "nation_22"], och_terms=["asia", "region_3", "EUROPE"])
    return cand.apply_filters(df, filters).select("title_key", "desk_subjects", "och_subjects")


@query
def subject_fill_rate(spark, sf_dir):
    return summaries.fill_rate(star_metrics(Roles(spark, sf_dir), subjects=True, opids=[]))


@query
def subject_vocabulary(spark, sf_dir):
    return summaries.vocabulary(Roles(spark, sf_dir).table("documents"), "text")


@query
def subject_suggestions(spark, sf_dir):
    terms = summaries.vocabulary(Roles(spark, sf_dir).table("documents"), "text")
    return summaries.suggestions(terms, " EN")


@query
def dictionary_suggestions(spark, sf_dir):
    """The same suggestions from a written dictionary of terms."""
    path = new_stage_path(spark, "dictionary")
    summaries.write_vocabulary(Roles(spark, sf_dir).table("documents"), "text", path)
    return summaries.suggestions_from(spark, path, " EN")


@query
def text_search(spark, sf_dir):
    docs = Roles(spark, sf_dir).table("documents")
    found = docs.filter(cand.search_terms("text", ["ouon[,.]", "Whth"]))
    return found.select("doc_id", "lang")


# --- enrichment --------------------------------------------------------------------------------------------------


@query
def title_assembly(spark, sf_dir):
    t = Roles(spark, sf_dir).titles()
    return assemble_titles(
        t.select("TITUL_KEY", "TITUL_SIGN_FULL"),
        t.select("TITUL_KEY", "TITUL_NAZEV"),
        t.select("TITUL_KEY", "TITUL_ZAHLAVI"),
        t.select("TITUL_KEY", F.col("TITUL_ROK_VYDANI").cast("string"), "TITUL_JAZYK", "TITUL_DRUH_DOKUMENTU"),
    )


@query
def doc_type_labels(spark, sf_dir):
    r = Roles(spark, sf_dir)
    return decode_doc_types(r.titles(), r.doc_types()).select("TITUL_KEY", "TITUL_DRUH_DOKUMENTU")


@query
def reader_demographics_(spark, sf_dir):
    return reader_demographics(Roles(spark, sf_dir).readers())


@query
def reader_groups_private(spark, sf_dir):
    return reader_demographics(Roles(spark, sf_dir).readers(), keep_exact_age=False, digits_only=True)


def _enriched_with_everything(r: Roles) -> DataFrame:
    return enrich_operations(
        r.operations(readers=True),
        r.copies(),
        r.titles(),
        r.op_types(),
        r.branches(),
        doc_types=r.doc_types(),
        subjects=title_subjects(**r.subject_tables()),
        readers=r.readers(),
    )


@query
def enriched_operations(spark, sf_dir):
    return portable(_enriched_with_everything(Roles(spark, sf_dir)))


@query
def enriched_from_buckets(spark, sf_dir):
    """The same from dimensions written in buckets of their keys; every copy and reader with a thousandth of the rows is treated as hot."""
    r = Roles(spark, sf_dir)
    dims = save_dimensions(
        spark, r.copies(), r.titles(), subjects=title_subjects(**r.subject_tables()), doc_types=r.doc_types(), readers=r.readers(),
        path=new_stage_path(spark, "dimensions"), copy_texts=False,
    )
    rows = enrich_from_dimensions(
        r.operations(readers=True), dims["dim_svazky_klice"], r.op_types(), r.branches(), demographics=dims["dim_ctenari"],
        described_titles=dims["dim_tituly_predmety"], least_rows=2,
    )
    return portable(rows)


@query
def enriched_by_reader_group(spark, sf_dir):
    df = _enriched_with_everything(Roles(spark, sf_dir))
    return df.groupBy("VEK_BUCKET", "POHLAVI", "ACTION_GROUP", "YEAR_MONTH").agg(F.count("*").alias("n"))


@query
def calendar_attributes(spark, sf_dir):
    from shelfwise.functions.calendar import calendar_columns

    events = Roles(spark, sf_dir).table("events")
    return portable(events.select("event_id", *[c.alias(n) for n, c in calendar_columns(F.col("ts")).items()]))


@query
def validate_build_(spark, sf_dir):
    r = Roles(spark, sf_dir)
    return portable(validate_build(r.enriched(), r.copies(), r.titles()))


# --- sources and sinks -------------------------------------------------------------------------------------------


@query
def ingest_fixed_width(spark, sf_dir):
    titles = Roles(spark, sf_dir).titles()
    path = new_stage_path(spark, "dump-titles")
    write_dump(titles, path)
    return read_dump(spark, path)


@query
def ingest_operations(spark, sf_dir):
    """Dumped operations parsed, with times kept as text as in the staging tables, and counted by day."""
    path = new_stage_path(spark, "dump-operations")
    write_dump(Roles(spark, sf_dir).operations(), path)
    rows = read_dump(spark, path)
    return rows.groupBy("STAT_VYP_TIME", "STAT_VYP_OPID").agg(
        F.count("*").alias("n"), F.sum("STAT_VYP_PTR_SVAZKY").cast("decimal(38,0)").cast("string").alias("keys")
    )


@query
def charset_normalise(spark, sf_dir):
    """Texts as windows-1250 bytes, decoded without being told so."""
    docs = Roles(spark, sf_dir).table("documents")
    content = docs.select("doc_id", encode_windows_1250(F.col("text")).alias("content"))
    return content.select("doc_id", F.md5(F.encode(decode_bytes(F.col("content")), "UTF-8")).alias("digest"))


@query
def charset_conversion(spark, sf_dir):
    """Files of windows-1250 lines converted to UTF-8; lines of files that need no conversion are read as they are."""
    docs = Roles(spark, sf_dir).table("documents")
    lines = docs.select(F.explode(F.split("text", "[\r\n]+")).alias("line"))
    # Each byte is written as the latin-1 character of the same number.
    content = lines.select(F.decode(encode_windows_1250(F.col("line")), "ISO-8859-1").alias("value"))
    source, target = new_stage_path(spark, "cp1250"), new_stage_path(spark, "utf8")
    options = {"encoding": "ISO-8859-1", "quote": "", "sep": "\x01", "emptyValue": ""}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    content.repartition(file_count(size)).write.options(**options).csv(source)
    report = convert_to_utf8(spark, source, target, pattern="*.csv")
    unchanged = raw_lines(spark, source, pathGlobFilter="*.csv").join(report.filter("NOT changed"), "path")
    kept = unchanged.select(F.col("content").cast("string").alias("value"))
    converted = spark.read.option("recursiveFileLookup", "true").text(target).select("value")
    both = converted.unionByName(kept).filter("value <> ''")
    return both.groupBy(F.md5(F.encode("value", "UTF-8")).alias("digest")).agg(F.count("*").alias("n"))


@query
def export_roundtrip(spark, sf_dir):
    """Export per class with the summary per prefix, both read back with all columns."""
    df = classified(Roles(spark, sf_dir), opids=[])
    path = new_stage_path(spark, "export")
    export_by_class(df, summaries.by_prefix(df), path)
    titles, summary = spark.read.parquet(f"{path}/tituly"), spark.read.parquet(f"{path}/souhrn_po_signaturach")
    return portable(titles.join(summary, "SIGN_PREFIX", "left"))


@query
def export_csv(spark, sf_dir):
    df = classified(Roles(spark, sf_dir), opids=[]).select("title_key", "TITUL_NAZEV", "klasifikace", "duvod_oznaceni")
    path = new_stage_path(spark, "csv")
    write_csv(df, path)
    return spark.read.option("header", True).option("escape", '"').schema(df.schema).csv(path)


@query
def rebuild_report(spark, sf_dir):
    """The whole batch, from dumps of every table to the report."""
    r = Roles(spark, sf_dir)
    raw, derived = new_stage_path(spark, "raw"), new_stage_path(spark, "derived")
    titles = r.titles()
    dumps = {
        "vypujcky1995-01.txt": r.operations(readers=True),
        "svazky-1.txt": r.copies().filter("SVAZKY_KEY % 2 = 0"),
        "svazky-2.txt": r.copies().filter("SVAZKY_KEY % 2 = 1"),
        "tituly-signatura.txt": titles.select("TITUL_KEY", "TITUL_SIGN_FULL"),
        "tituly-nazev.txt": titles.select("TITUL_KEY", "TITUL_NAZEV"),
        "tituly-zahlavi.txt": titles.select("TITUL_KEY", "TITUL_ZAHLAVI"),
        "tituly-rokjazykdruh.txt": titles.select(
            "TITUL_KEY", "TITUL_ROK_VYDANI", "TITUL_JAZYK", "TITUL_DRUH_DOKUMENTU"
        ),
        "opidy.txt": r.op_types(),
        "knihovny.txt": r.branches(),
        "druhdokumentu.txt": r.doc_types(),
        "legitky.txt": r.readers(),
        "och.txt": r.och(),
        "txoch.txt": r.txoch(),
        "desk.txt": r.desk(),
        "txdesk.txt": r.txdesk(),
    }
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda item: write_dump(item[1], f"{raw}/{item[0]}"), dumps.items()))
    report = rebuild_all(spark, raw, derived, policy=POLICY)
    titles_built = spark.read.parquet(table_path(derived, "titles_metrics")).agg(
        F.count("*").alias("metrics_titles"), F.sum("vypujcky_5_let").alias("metrics_loans")
    )
    row = titles_built.select(F.struct("*")).scalar()
    return portable(report.withColumn("m", row).select("*", "m.*").drop("m"))
