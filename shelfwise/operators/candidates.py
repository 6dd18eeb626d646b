"""Filtering of classified titles and ranked candidate lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.labels import COUNT_LABELS, OPID_COUNT_PREFIX, column_label
from shelfwise.functions.rules import CLASSES
from shelfwise.functions.scores import buy_score, write_off_score
from shelfwise.functions.text import any_of, contains
from shelfwise.operators.quantiles import exact_quantiles_of

# Lengths of the lists.
TOP_CANDIDATES = 50
TOP_UNCLEAR = 25
TOP_PREFIXES = 10
MAX_SUGGESTIONS = 80

# Labels of the two kinds of unclear titles.
UNCLEAR_HIGH = "hodně svazků + vysoký výkon"
UNCLEAR_LOW = "málo svazků + nízký výkon"

# Columns of the candidate and result lists, in their order.
CANDIDATE_COLUMNS = (
    "TITUL_NAZEV",
    "SIGN_PREFIX",
    "TITUL_SIGN_FULL",
    "pocet_svazku",
    "vypujcky_okno",
    "vykon_na_svazek",
    "klasifikace",
)
TOTAL_COLUMNS = ("pocet_operaci_v_obdobi", "pocet_vypujcek_is_loan", "pocet_vraceni_is_return")
RESULT_COLUMNS_BEFORE = (
    "TITUL_NAZEV",
    "SIGN_PREFIX",
    "TITUL_SIGN_FULL",
    "TITUL_KEY",
    "TITUL_DRUH_DOKUMENTU",
    "TITUL_JAZYK",
    "TITUL_ROK_VYDANI",
    "okno_let",
    "vypujcky_okno",
)
RESULT_COLUMNS_AFTER = (
    "pocet_svazku",
    "vykon_na_svazek",
    "datum_posledni_vypujcky",
    "roky_od_posledni_vypujcky",
    "percentil_v_signature",
    "relativni_pozice_v_signature",
    "rizikove_skore",
    "bez_vypujcek",
    "bez_svazku",
    "desk_subjects",
    "och_subjects",
    "klasifikace",
    "duvod_oznaceni",
    "vyjimka_flag",
)

Range = tuple[float | None, float | None]


def number(name: str) -> Column:
    """Column as DOUBLE, 0 for NULL and for text that is no number."""
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def in_range(value: Column, bounds: Range) -> Column:
    low, high = bounds
    tests = [value >= low] if low is not None else []
    tests += [value <= high] if high is not None else []
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


@dataclass(frozen=True)
class Filters:
    """Selection of titles; an empty entry selects everything."""

    prefixes: Sequence[str] = ()
    languages: Sequence[str] = ()
    doc_types: Sequence[str] = ()
    classes: Sequence[str] = CLASSES
    name: str = ""
    desk_terms: Sequence[str] = ()
    och_terms: Sequence[str] = ()
    count_column: str | None = None
    count_range: Range = (None, None)
    copies_range: Range = (None, None)
    use_range: Range = (None, None)
    literal: bool = False
    extra: Sequence[Column] = field(default_factory=tuple)


def search_terms(column: str, terms: Sequence[str], *, literal: bool = False) -> Column:
    """True when the text holds any of the terms."""
    return any_of([contains(F.col(column), t, literal=literal) for t in terms])


def apply_filters(titles: DataFrame, filters: Filters) -> DataFrame:
    """All filters are plain predicates on columns, so they can reach the scan of a table of titles."""
    have = set(titles.columns)
    tests = []
    for column, wanted in (
        ("SIGN_PREFIX", filters.prefixes),
        ("TITUL_JAZYK", filters.languages),
        ("TITUL_DRUH_DOKUMENTU", filters.doc_types),
        ("klasifikace", filters.classes),
    ):
        if wanted:
            tests.append(F.col(column).isin(*wanted))
    if filters.name:
        tests.append(contains(F.col("TITUL_NAZEV"), filters.name, literal=filters.literal))
    for column, terms in (("desk_subjects", filters.desk_terms), ("och_subjects", filters.och_terms)):
        terms = [t for t in terms if t.strip()]
        if terms and column in have:
            tests.append(search_terms(column, terms, literal=filters.literal))
    for column, bounds in (
        (filters.count_column, filters.count_range),
        ("pocet_svazku", filters.copies_range),
        ("vykon_na_svazek", filters.use_range),
    ):
        if column in have and bounds != (None, None):
            tests.append(in_range(number(column), bounds))
    out = titles
    for t in [*tests, *filters.extra]:
        out = out.filter(t)
    return out


def count_filter_bounds(titles: DataFrame, column: str, *, cap: int | None = None) -> tuple[int, int]:
    """Greatest count and the upper end offered for filtering: the same, unless a caller caps what it displays."""
    top = titles.agg(F.max(number(column)).alias("m")).first()["m"]
    greatest = max(int(top or 0), 1)
    return greatest, greatest if cap is None else min(greatest, cap)


def count_filter_labels(titles: DataFrame) -> DataFrame:
    """The counts that titles can be filtered by, each with its label and greatest value, from one pass."""
    counts = [c for c in titles.columns if c in COUNT_LABELS or c.startswith(OPID_COUNT_PREFIX)]
    if not counts:
        return titles.sparkSession.createDataFrame([], "sloupec string, popisek string, nejvyssi bigint")
    tops = titles.agg(*[F.max(number(c)).cast("bigint").alias(c) for c in counts])
    rows = [
        F.struct(
            F.lit(c).alias("sloupec"),
            F.lit(COUNT_LABELS.get(c, column_label(c))).alias("popisek"),
            F.greatest(F.col(c), F.lit(1)).cast("bigint").alias("nejvyssi"),
        )
        for c in counts
    ]
    return tops.select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class RecommendedRanges:
    """Limits taken from the distribution of copies and of loans per copy."""

    copies_high: int
    use_low: float
    copies_low: int
    use_high: float
    max_copies: int
    max_use: float

    @property
    def write_off(self) -> dict[str, Range]:
        return {
            "copies_range": (self.copies_high, self.max_copies),
            "use_range": (0.0, max(0.0, self.use_low)),
        }

    @property
    def buy(self) -> dict[str, Range]:
        return {
            "copies_range": (0, min(self.copies_low, self.max_copies)),
            "use_range": (max(0.0, self.use_high), self.max_use),
        }


def recommended_ranges(titles: DataFrame) -> RecommendedRanges:
    numbers = titles.select(number("pocet_svazku").alias("copies"), number("vykon_na_svazek").alias("use"))
    found = exact_quantiles_of(numbers, {"copies": [0.10, 0.90, 1.0], "use": [0.20, 0.80, 1.0]})
    copies_10, copies_90, copies_max = (x or 0.0 for x in found["copies"])
    use_20, use_80, use_max = (x or 0.0 for x in found["use"])
    return RecommendedRanges(
        copies_high=int(max(3, copies_90)),
        use_low=use_20,
        copies_low=int(max(1, copies_10)),
        use_high=use_80,
        max_copies=max(1, int(copies_max)),
        max_use=max(1.0, use_max),
    )


def _numeric(titles: DataFrame) -> DataFrame:
    return titles.withColumns(
        {"pocet_svazku": F.floor(number("pocet_svazku")).cast("bigint"), "vykon_na_svazek": number("vykon_na_svazek")}
    )


def _selected(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def write_off_candidates(
    titles: DataFrame, *, min_copies: float | None = None, max_use: float | None = None, k: int = TOP_CANDIDATES
) -> DataFrame:
    """Many copies, little use: highest score first."""
    rows = _numeric(titles)
    rows = rows.filter(in_range(F.col("pocet_svazku"), (min_copies, None)))
    rows = rows.filter(in_range(F.col("vykon_na_svazek"), (None, max_use)))
    scored = rows.withColumn("skore_odpis", write_off_score(F.col("pocet_svazku"), F.col("vykon_na_svazek")))
    return scored.orderBy(F.desc("skore_odpis"), F.desc("pocet_svazku"), "title_key").limit(k)


def buy_candidates(
    titles: DataFrame, *, max_copies: float | None = None, min_use: float | None = None, k: int = TOP_CANDIDATES
) -> DataFrame:
    """Few copies, much use: highest score first."""
    rows = _numeric(titles)
    rows = rows.filter(in_range(F.col("pocet_svazku"), (None, max_copies)))
    rows = rows.filter(in_range(F.col("vykon_na_svazek"), (min_use, None)))
    scored = rows.withColumn("skore_dokup", buy_score(F.col("pocet_svazku"), F.col("vykon_na_svazek")))
    return scored.orderBy(F.desc("skore_dokup"), F.desc("vykon_na_svazek"), "title_key").limit(k)


def medians(titles: DataFrame) -> tuple[int, float]:
    """Median number of copies (cut to a whole number) and median loans per copy."""
    rows = _numeric(titles)
    found = exact_quantiles_of(rows, {"pocet_svazku": [0.5], "vykon_na_svazek": [0.5]})
    return int(found["pocet_svazku"][0] or 0), found["vykon_na_svazek"][0] or 0.0


def unclear_cases(titles: DataFrame, *, k: int = TOP_UNCLEAR) -> DataFrame:
    """Titles with many copies and much use, and with few and little; titles on both medians can be in both lists."""
    rows = _numeric(titles)
    copies_mid, use_mid = medians(titles)
    copies, use = F.col("pocet_svazku"), F.col("vykon_na_svazek")
    high = rows.filter((copies >= copies_mid) & (use >= use_mid)).withColumn("typ", F.lit(UNCLEAR_HIGH))
    low = rows.filter((copies <= copies_mid) & (use <= use_mid)).withColumn("typ", F.lit(UNCLEAR_LOW))
    high = high.orderBy(F.desc("pocet_svazku"), F.desc("vykon_na_svazek"), "title_key").limit(k)
    low = low.orderBy("vykon_na_svazek", "pocet_svazku", "title_key").limit(k)
    return high.unionByName(low)


def candidate_table(candidates: DataFrame) -> DataFrame:
    return _selected(candidates, ("typ", *CANDIDATE_COLUMNS))


def result_table(titles: DataFrame) -> DataFrame:
    """Columns of the result list in their fixed order."""
    opids = sorted(c for c in titles.columns if c.startswith(OPID_COUNT_PREFIX))
    return _selected(titles, (*RESULT_COLUMNS_BEFORE, *TOTAL_COLUMNS, *opids, *RESULT_COLUMNS_AFTER))
