"""An independent statement of every registered query in plain SQL over the given tables."""

from __future__ import annotations

from shelfwise.sources.charset import DEFINED

# --- library tables derived from the given ones --------------------------------------------------------------------

TITLES = """tituly AS (
  SELECT p_partkey AS TITUL_KEY, p_type || ' ' || CAST(p_partkey AS VARCHAR) AS TITUL_SIGN_FULL,
         p_name AS TITUL_NAZEV, p_brand AS TITUL_ZAHLAVI, CAST(1970 + p_size AS BIGINT) AS TITUL_ROK_VYDANI,
         p_brand AS TITUL_JAZYK, p_type AS TITUL_DRUH_DOKUMENTU
  FROM part)"""

COPIES = """svazky AS (
  SELECT DISTINCT l_partkey * 1000000 + l_suppkey AS SVAZKY_KEY, l_partkey AS SVAZKY_PTR_TITUL FROM lineitem)"""

# Operations with their code, description and class.
OPS = """ops AS (
  SELECT l.*, l_partkey * 1000000 + l_suppkey AS copy_key,
         CAST(CASE l_returnflag || l_linestatus WHEN 'RF' THEN 4 WHEN 'RO' THEN 97 WHEN 'AF' THEN 5 WHEN 'AO' THEN 98
                   WHEN 'NF' THEN 7 ELSE 8 END AS BIGINT) AS opid,
         CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'loan out' WHEN 'RO' THEN 'loan in house'
              WHEN 'AF' THEN 'return out' WHEN 'AO' THEN 'return in house' WHEN 'NF' THEN 'renewal check' END AS popis,
         l_returnflag = 'R' AS is_loan, l_returnflag = 'A' AS is_return,
         CASE l_returnflag WHEN 'R' THEN 'loan' WHEN 'A' THEN 'return' ELSE 'other' END AS grp
  FROM lineitem l)"""

DESK = """desk AS (
  SELECT DISTINCT l_partkey AS t, s_nationkey AS ptr FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey)"""

SUBJECTS = f"""{DESK},
desk_agg AS (
  SELECT t, string_agg(DISTINCT n_name, ' | ' ORDER BY n_name) AS desk_subjects
  FROM desk LEFT JOIN nation ON n_nationkey = ptr GROUP BY t),
och_agg AS (
  SELECT t, string_agg(DISTINCT r_name, ' | ' ORDER BY r_name) AS och_subjects
  FROM desk LEFT JOIN nation ON n_nationkey = ptr LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY t),
subjects AS (
  SELECT d.t AS TITUL_KEY, coalesce(och_subjects, '') AS och_subjects, coalesce(desk_subjects, '') AS desk_subjects
  FROM desk_agg d FULL JOIN och_agg o ON o.t = d.t)"""

PREFIX = "upper(substr(regexp_extract(TITUL_SIGN_FULL, '^([A-Za-z]+)', 1), 1, 2))"
OPIDS = (4, 5, 7, 8, 97, 98)


def metrics(
    *,
    years: int = 2,
    label_types: bool = True,
    subjects: bool = False,
    opids: tuple[int, ...] = (),
    frame: bool = False,
) -> str:
    """CTEs that end in ``m``: one row per title. No key of the given tables is NULL or spelled in two ways."""
    doc = "CASE WHEN p_type = 'STANDARD' THEN p_type ELSE 'type ' || lower(p_type) END" if label_types else "p_type"
    pivot = "".join(
        f", count(*) FILTER (WHERE inside AND opid = {k}) AS pocet_opid_{k}" for k in opids
    )
    pivot_names = "".join(f", pocet_opid_{k}" for k in opids)
    percent = (
        "(pocet_v_signature - rank_v_signature) / CAST(pocet_v_signature AS DOUBLE) * 100.0"
        if frame
        else "(pocet_v_signature - rank_v_signature) * CAST(100 AS DOUBLE) / pocet_v_signature"
    )
    with_subjects = f"{SUBJECTS}," if subjects else ""
    subject_columns = "s.desk_subjects, s.och_subjects" if subjects else "'' AS desk_subjects, '' AS och_subjects"
    subject_join = "LEFT JOIN subjects s ON s.TITUL_KEY = u.l_partkey" if subjects else ""
    return f"""{TITLES}, {COPIES}, {OPS}, {with_subjects}
period AS (SELECT max(l_shipdate) AS until, max(l_shipdate) - INTERVAL {years} YEAR AS since FROM lineitem),
usage AS (
  SELECT l_partkey,
         count(*) FILTER (WHERE inside AND is_loan) AS vypujcky_5_let,
         max(l_shipdate) FILTER (WHERE inside AND is_loan) AS last_loan,
         count(*) FILTER (WHERE inside) AS pocet_operaci_v_obdobi,
         count(*) FILTER (WHERE inside AND is_loan) AS pocet_vypujcek_is_loan,
         count(*) FILTER (WHERE inside AND is_return) AS pocet_vraceni_is_return,
         count(DISTINCT copy_key) AS pocet_svazku {pivot}
  FROM (SELECT o.*, l_shipdate BETWEEN since AND until AS inside FROM ops o, period) GROUP BY l_partkey),
placed AS (
  SELECT t.TITUL_SIGN_FULL || '||' || t.TITUL_NAZEV AS title_key, t.TITUL_KEY, t.TITUL_SIGN_FULL,
         {PREFIX} AS SIGN_PREFIX, t.TITUL_NAZEV, {doc} AS TITUL_DRUH_DOKUMENTU, t.TITUL_JAZYK,
         CAST(t.TITUL_ROK_VYDANI AS DOUBLE) AS TITUL_ROK_VYDANI, {subject_columns}, u.* EXCLUDE (l_partkey),
         rank() OVER (PARTITION BY {PREFIX} ORDER BY vypujcky_5_let DESC) AS rank_v_signature,
         count(*) OVER (PARTITION BY {PREFIX}) AS pocet_v_signature
  FROM usage u JOIN tituly t ON t.TITUL_KEY = u.l_partkey JOIN part ON p_partkey = u.l_partkey {subject_join}),
scored AS (
  SELECT p.*, coalesce(vypujcky_5_let / nullif(CAST(pocet_svazku AS DOUBLE), 0), 0) AS vykon_na_svazek,
         {percent} AS percentil_v_signature,
         rank_v_signature || '/' || pocet_v_signature AS relativni_pozice_v_signature,
         round(date_diff('day', last_loan, until) / 365.25, 2) AS roky_od_posledni_vypujcky
  FROM placed p, period),
m AS (
  SELECT title_key, TITUL_KEY, TITUL_SIGN_FULL, SIGN_PREFIX, TITUL_NAZEV, TITUL_DRUH_DOKUMENTU, TITUL_JAZYK,
         TITUL_ROK_VYDANI, desk_subjects, och_subjects, pocet_operaci_v_obdobi, pocet_vypujcek_is_loan,
         pocet_vraceni_is_return {pivot_names}, vypujcky_5_let, pocet_svazku, vykon_na_svazek,
         CAST(last_loan AS VARCHAR) AS datum_posledni_vypujcky, rank_v_signature, pocet_v_signature,
         percentil_v_signature, relativni_pozice_v_signature, roky_od_posledni_vypujcky,
         CAST({years} AS INTEGER) AS okno_let, vypujcky_5_let AS vypujcky_okno, vypujcky_5_let = 0 AS bez_vypujcek,
         pocet_svazku = 0 AS bez_svazku,
         CAST(CASE WHEN vypujcky_5_let = 0 THEN 70 WHEN vypujcky_5_let <= 2 THEN 20 ELSE 0 END
              + CASE WHEN percentil_v_signature <= 30 THEN 10 ELSE 0 END
              + CASE WHEN coalesce(roky_od_posledni_vypujcky, 99) > 3 THEN 15 ELSE 0 END AS INTEGER) AS rizikove_skore
  FROM scored)"""


OTHER_REASON = "chráněno výjimkou (shoda s pravidlem)"


def classes(*, stale: float = 1.0, auto_max: int = 3, source: str = "m") -> str:
    """CTE ``c``: titles with class and reason."""
    auto_reason = (
        f"nejvýše {auto_max} výpůjček v okně analýzy (automatický kandidát)"
        if auto_max
        else "0 výpůjček v okně analýzy (automatický kandidát)"
    )
    return f"""tested AS (
  SELECT *, TITUL_NAZEV LIKE '%red%' AS vyjimka_flag,
         coalesce(roky_od_posledni_vypujcky, 999) > {stale} AS is_stale,
         vypujcky_5_let BETWEEN 1 AND 2 AND percentil_v_signature <= 30 AS is_low
  FROM {source}),
c AS (
  SELECT * EXCLUDE (is_stale, is_low),
         CASE WHEN vyjimka_flag THEN 'CHRANENO_VYJIMKOU' WHEN is_stale OR is_low THEN 'RUCNI_POSOUZENI'
              WHEN vypujcky_5_let <= {auto_max} THEN 'AUTO_KANDIDAT' ELSE 'PONECHAT' END AS klasifikace,
         CASE WHEN vyjimka_flag THEN '{OTHER_REASON}'
              WHEN is_stale THEN 'poslední výpůjčka starší než {stale:.1f} roku'
              WHEN is_low THEN 'nízká výpůjčnost (1–2) a spodní 30 % ve signatuře'
              WHEN vypujcky_5_let <= {auto_max} THEN '{auto_reason}'
              ELSE 'nedostatečný důvod pro změnu stavu (běžný výskyt / lepší pozice ve signatuře)' END AS duvod_oznaceni
  FROM tested)"""


def from_metrics(select: str, **options) -> str:
    return f"WITH {metrics(**options)} {select}"


def from_classes(select: str, *, more: str = "", **options) -> str:
    return f"WITH {metrics(**options)}, {classes()}{', ' + more if more else ''} {select}"


COUNTS_LONG = f"""WITH {TITLES}, {OPS}
SELECT TITUL_SIGN_FULL || '||' || TITUL_NAZEV AS title_key, opid, count(*) AS n FROM ops JOIN tituly ON TITUL_KEY = l_partkey
WHERE l_shipdate >= (SELECT max(l_shipdate) - INTERVAL 2 YEAR FROM lineitem) GROUP BY 1, 2"""

MATRIX = """matrix AS (
  SELECT SIGN_PREFIX,
         count(DISTINCT title_key) FILTER (WHERE klasifikace = 'AUTO_KANDIDAT') AS AUTO_KANDIDAT,
         count(DISTINCT title_key) FILTER (WHERE klasifikace = 'RUCNI_POSOUZENI') AS RUCNI_POSOUZENI,
         count(DISTINCT title_key) FILTER (WHERE klasifikace = 'CHRANENO_VYJIMKOU') AS CHRANENO_VYJIMKOU,
         count(DISTINCT title_key) FILTER (WHERE klasifikace = 'PONECHAT') AS PONECHAT
  FROM c GROUP BY SIGN_PREFIX)"""

CANDIDATE_COLUMNS = (
    "title_key, TITUL_NAZEV, SIGN_PREFIX, TITUL_SIGN_FULL, pocet_svazku, vypujcky_okno, vykon_na_svazek, klasifikace"
)
WRITE_OFF = "(greatest(pocet_svazku, 1) - 1) / (vykon_na_svazek + 1e-9)"
BUY = "(vykon_na_svazek + 1e-9) / greatest(pocet_svazku, 1)"

RANGES = """ranges AS (
  SELECT CAST(trunc(greatest(3, quantile_cont(pocet_svazku, 0.9))) AS INTEGER) AS copies_high,
         quantile_cont(vykon_na_svazek, 0.2) AS use_low,
         CAST(trunc(greatest(1, quantile_cont(pocet_svazku, 0.1))) AS INTEGER) AS copies_low,
         quantile_cont(vykon_na_svazek, 0.8) AS use_high,
         CAST(greatest(1, max(pocet_svazku)) AS INTEGER) AS max_copies,
         greatest(1.0, max(vykon_na_svazek)) AS max_use
  FROM c)"""

ALL_TERMS = """terms AS (
  SELECT DISTINCT regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS term
  FROM (SELECT unnest(regexp_split_to_array(text, '[|;,]')) AS part FROM documents)
  WHERE length(regexp_replace(part, '^\\s+|\\s+$', '', 'g')) >= 2)"""

READERS = """readers AS (
  SELECT c_custkey AS LEG_KEY, CAST(floor(c_acctbal / 100) AS BIGINT) AS VEK, c_nationkey % 8 AS sex, c_custkey AS k
  FROM customer),
reader_groups AS (
  SELECT LEG_KEY, VEK,
         CASE WHEN VEK < 0 THEN NULL WHEN VEK <= 5 THEN '0-5' WHEN VEK <= 12 THEN '6-12' WHEN VEK <= 17 THEN '13-17'
              WHEN VEK <= 24 THEN '18-24' WHEN VEK <= 34 THEN '25-34' WHEN VEK <= 44 THEN '35-44'
              WHEN VEK <= 54 THEN '45-54' WHEN VEK <= 64 THEN '55-64' WHEN VEK <= 74 THEN '65-74'
              WHEN VEK <= 84 THEN '75-84' ELSE '85+' END AS VEK_BUCKET,
         CASE WHEN sex > 1 THEN CAST(sex AS VARCHAR) END AS POHLAVI,
         CASE WHEN k % 10 > 2 THEN CAST(100 + k % 800 AS VARCHAR) END AS PSC_PREFIX
  FROM readers)"""

ENRICHED = f"""{TITLES}, {OPS}, {SUBJECTS}, {READERS},
enriched AS (
  SELECT copy_key AS VYP_PTR_SVAZKY, CAST(l_shipdate AS VARCHAR) AS VYP_TIME, opid AS VYP_OPID,
         l_suppkey AS VYP_PTR_KNODDEL, CASE WHEN opid <> 8 THEN opid END AS OPIDY_OPID, popis AS OPIDY_POPIS,
         s_suppkey AS KNODDEL_KEY, s_name AS KNODDEL_NAZEV, n_name AS KNODDEL_ULICE,
         CAST(s_nationkey AS VARCHAR) AS KNODDEL_PSC, copy_key AS SVAZKY_KEY, l_partkey AS SVAZKY_PTR_TITUL,
         CAST(l_partkey AS VARCHAR) AS SVAZKY_PTR_TITUL_STR, l_partkey AS TITUL_KEY, TITUL_SIGN_FULL, TITUL_ZAHLAVI,
         TITUL_NAZEV, TITUL_ROK_VYDANI, TITUL_JAZYK,
         CASE WHEN TITUL_DRUH_DOKUMENTU = 'STANDARD' THEN 'STANDARD'
              ELSE 'type ' || lower(TITUL_DRUH_DOKUMENTU) END AS TITUL_DRUH_DOKUMENTU,
         CAST(l_partkey AS VARCHAR) AS TITUL_KEY_STR, strftime(l_shipdate, '%Y-%m-%d') AS DATE,
         CAST(year(l_shipdate) AS INTEGER) AS YEAR, CAST(month(l_shipdate) AS INTEGER) AS MONTH,
         CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS YEAR_MONTH,
         CAST(week(l_shipdate) AS INTEGER) AS WEEK, CAST(dayofweek(l_shipdate) AS INTEGER) AS WEEKDAY,
         is_loan AS IS_LOAN, is_return AS IS_RETURN, FALSE AS IS_RENEWAL, grp AS ACTION_GROUP,
         coalesce(popis, CAST(opid AS VARCHAR)) AS ACTION_TYPE, desk_subjects, och_subjects, VEK, VEK_BUCKET, POHLAVI,
         PSC_PREFIX
  FROM ops JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey
  JOIN tituly t ON t.TITUL_KEY = l_partkey JOIN subjects sj ON sj.TITUL_KEY = l_partkey
  LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN reader_groups ON LEG_KEY = o_custkey)"""

REPORT = f"""{COPIES},
sizes AS (SELECT count(*) AS n FROM svazky GROUP BY SVAZKY_PTR_TITUL),
report AS (
  SELECT (SELECT count(*) FROM lineitem) AS fact_rows,
         (SELECT count(*) FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL)
           AS fact_rows_missing_titul,
         (SELECT count(*) FROM lineitem WHERE l_partkey IS NULL OR l_suppkey IS NULL) AS fact_rows_missing_svazek,
         (SELECT strftime(min(l_shipdate), '%Y-%m-%d') FROM lineitem) AS min_date,
         (SELECT strftime(max(l_shipdate), '%Y-%m-%d') FROM lineitem) AS max_date,
         (SELECT count(DISTINCT l_partkey) FROM lineitem) AS fact_unique_tituly,
         (SELECT count(*) FROM lineitem JOIN svazky ON SVAZKY_KEY = l_partkey * 1000000 + l_suppkey)
           AS rows_with_svazky_ptr_titul,
         CAST(100 AS DOUBLE) AS pct_rows_with_titul_via_svazky,
         (SELECT min(n) FROM sizes) AS min_svazku,
         (SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) FROM sizes) AS median_svazku,
         (SELECT max(n) FROM sizes) AS max_svazku,
         (SELECT count(*) FROM part) AS dim_tituly_rows,
         (SELECT count(DISTINCT p_partkey) FROM part) AS dim_tituly_unique,
         (SELECT count(DISTINCT l_partkey) FROM lineitem) AS fact_tituly_unique)"""

CP1250_CLASS = "[^\\x00-\\x7F" + "".join(DEFINED.values()) + "]"

LABELLED = """SELECT TITUL_NAZEV AS "Název titulu", SIGN_PREFIX AS "Prefix signatury", TITUL_SIGN_FULL AS "Signatura",
  TITUL_KEY AS "ID titulu", TITUL_DRUH_DOKUMENTU AS "Druh dokumentu", TITUL_JAZYK AS "Jazyk",
  TITUL_ROK_VYDANI AS "Rok vydání", okno_let AS "Délka sledovaného období (roky)",
  vypujcky_okno AS "Počet výpůjček v období (pro výkon)",
  pocet_operaci_v_obdobi AS "Počet všech operací ve zvoleném období",
  pocet_vypujcek_is_loan AS "Počet výpůjček (IS_LOAN)", pocet_vraceni_is_return AS "Počet vrácení (IS_RETURN)",
  """ + ", ".join(f'pocet_opid_{k} AS "Počet operací (OPID {k})"' for k in sorted(OPIDS, key=str)) + """,
  pocet_svazku AS "Počet svazků na titul", vykon_na_svazek AS "Výkon na svazek (výpůjčky / svazek)",
  datum_posledni_vypujcky AS "Datum poslední výpůjčky", roky_od_posledni_vypujcky AS "Roky od poslední výpůjčky",
  percentil_v_signature AS "Percentil v rámci prefixu signatury",
  relativni_pozice_v_signature AS "Pořadí / počet titulů ve stejném prefixu", rizikove_skore AS "Rizikové skóre",
  bez_vypujcek AS "Bez výpůjček v období", bez_svazku AS "Bez svazku v datech",
  desk_subjects AS "Deskriptory (obsah)", och_subjects AS "Obsahová charakteristika (OCH)",
  duvod_oznaceni AS "Důvod označení", vyjimka_flag AS "Spadá pod výjimku (pravidla)",
  CASE klasifikace WHEN 'AUTO_KANDIDAT' THEN 'Automatický kandidát (nízký výskyt)'
    WHEN 'RUCNI_POSOUZENI' THEN 'Ruční posouzení' WHEN 'CHRANENO_VYJIMKOU' THEN 'Chráněno výjimkou'
    ELSE 'Ponechat' END AS "Klasifikace"
FROM c"""

CANDIDATES_SHOWN = CANDIDATE_COLUMNS.removeprefix("title_key, ")
SELECTED = "sel AS (SELECT * FROM c WHERE SIGN_PREFIX = 'PR' AND pocet_svazku >= 5)"
KPI_ROW = """k AS (SELECT count(DISTINCT title_key) AS titulu_celkem,
       count(*) FILTER (WHERE klasifikace = 'AUTO_KANDIDAT') AS AUTO_KANDIDAT,
       count(*) FILTER (WHERE klasifikace = 'RUCNI_POSOUZENI') AS RUCNI_POSOUZENI,
       count(*) FILTER (WHERE klasifikace = 'CHRANENO_VYJIMKOU') AS CHRANENO_VYJIMKOU,
       count(*) FILTER (WHERE klasifikace = 'PONECHAT') AS PONECHAT,
       CAST(sum(pocet_svazku) AS BIGINT) AS svazku_celkem, round(avg(vykon_na_svazek), 6) AS prum_vykon FROM c)"""
KPI = """SELECT *, round(100.0 * AUTO_KANDIDAT / titulu_celkem, 6) AS podil_AUTO_KANDIDAT,
       round(100.0 * RUCNI_POSOUZENI / titulu_celkem, 6) AS podil_RUCNI_POSOUZENI,
       round(100.0 * CHRANENO_VYJIMKOU / titulu_celkem, 6) AS podil_CHRANENO_VYJIMKOU,
       round(100.0 * PONECHAT / titulu_celkem, 6) AS podil_PONECHAT FROM k"""
UNCLEAR = f"""SELECT * FROM (SELECT 'hodně svazků + vysoký výkon' AS typ, {CANDIDATES_SHOWN} FROM sel, mid
  WHERE pocet_svazku >= mc AND vykon_na_svazek >= mu ORDER BY pocet_svazku DESC, vykon_na_svazek DESC, title_key LIMIT 25)
UNION ALL
SELECT * FROM (SELECT 'málo svazků + nízký výkon' AS typ, {CANDIDATES_SHOWN} FROM sel, mid
  WHERE pocet_svazku <= mc AND vykon_na_svazek <= mu ORDER BY vykon_na_svazek, pocet_svazku, title_key LIMIT 25)"""


def from_review(select: str) -> str:
    """Over the classified titles that the review selects."""
    mid = "mid AS (SELECT trunc(median(pocet_svazku)) AS mc, median(vykon_na_svazek) AS mu FROM sel)"
    parts = [SELECTED, *[x.replace("FROM c", "FROM sel") for x in (MATRIX, KPI_ROW)], mid]
    return from_classes(select, more=", ".join(parts))


ORACLE: dict[str, str] = {
    "title_metrics": from_metrics("SELECT * FROM m"),
    "title_metrics_opid_pivot": from_metrics(
        "SELECT title_key, pocet_operaci_v_obdobi, pocet_vypujcek_is_loan, pocet_vraceni_is_return, "
        + ", ".join(f"pocet_opid_{k}" for k in OPIDS)
        + " FROM m",
        opids=OPIDS,
    ),
    "opid_counts_long": COUNTS_LONG,
    "opid_counts_wide": COUNTS_LONG,
    "titles_with_opid_counts": from_metrics(
        "SELECT title_key, pocet_opid_97, pocet_opid_8, CAST(0 AS BIGINT) AS pocet_opid_12345 FROM m", opids=OPIDS
    ),
    "operations_summary": f"""WITH {OPS}
SELECT coalesce(popis, CAST(opid AS VARCHAR)) AS ACTION_TYPE, grp AS ACTION_GROUP, is_loan AS IS_LOAN, opid AS VYP_OPID,
       popis AS OPIDY_POPIS, CAST(max(l_shipdate) AS VARCHAR) AS DATE, CAST(max(year(l_shipdate)) AS INTEGER) AS YEAR, count(*) AS n
FROM ops GROUP BY 1, 2, 3, 4, 5""",
    "title_metrics_wide": from_metrics("SELECT * FROM m", label_types=False),
    "title_metrics_wide_subjects": from_metrics("SELECT * FROM m", subjects=True),
    "title_metrics_frame_subjects": from_metrics("SELECT * FROM m", subjects=True, opids=(4, 98), frame=True),
    "title_metrics_flags": from_metrics(
        "SELECT title_key, vypujcky_5_let, pocet_svazku, vykon_na_svazek, rizikove_skore FROM m", years=3
    ),
    "title_metrics_frame": from_metrics("SELECT * FROM m", label_types=False, opids=OPIDS, frame=True),
    "title_metrics_upload": from_metrics(
        "SELECT title_key, vypujcky_5_let, vypujcky_5_let AS vypujcky_okno, pocet_svazku, 2 AS okno_let FROM m",
        label_types=False, opids=OPIDS, frame=True,
    ),
    "metrics_one_prefix": from_metrics(
        "SELECT title_key, SIGN_PREFIX, vypujcky_5_let, rank_v_signature, pocet_v_signature FROM m "
        "WHERE SIGN_PREFIX = 'PR'"
    ),
    "risk_score": from_metrics("SELECT title_key, bez_vypujcek, bez_svazku, rizikove_skore FROM m"),
    "window_filter": f"""WITH {OPS}
SELECT popis AS ACTION_TYPE, CAST(year(l_shipdate) AS INTEGER) AS YEAR, count(*) AS n FROM ops
WHERE is_loan AND l_shipdate >= (SELECT max(l_shipdate) - INTERVAL 2 YEAR FROM lineitem) GROUP BY 1, 2""",
    "cleaned_events": f"""WITH {OPS}
SELECT p_name AS TITUL_NAZEV, coalesce(popis, CAST(opid AS VARCHAR)) AS ACTION_TYPE,
       CAST(year(l_shipdate) AS INTEGER) AS YEAR, '' AS desk_subjects, count(*) AS n,
       CAST(min(l_shipdate) AS VARCHAR) AS first, CAST(max(l_shipdate) AS VARCHAR) AS last
FROM ops JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3""",
    "action_types": f"WITH {OPS} SELECT DISTINCT coalesce(popis, CAST(opid AS VARCHAR)) AS a FROM ops ORDER BY a",
    "suggested_loan_actions": f"WITH {OPS} SELECT DISTINCT popis AS a FROM ops WHERE is_loan ORDER BY a",
    "distinct_opids": f"WITH {OPS} SELECT DISTINCT opid FROM ops ORDER BY opid",
    "opid_legend": f"WITH {OPS} SELECT opid, max(popis) AS popis FROM ops GROUP BY opid ORDER BY opid",
    "opid_labels": f"""WITH {OPS}
SELECT opid, coalesce(max(popis) || ' (OPID ' || opid || ')', 'OPID ' || opid) AS popisek
FROM ops GROUP BY opid ORDER BY opid""",
    "prefix_summary": f"""WITH {TITLES}
SELECT {PREFIX} AS SIGN_PREFIX, count(*) AS TITULU FROM tituly
WHERE TITUL_KEY IN (SELECT l_partkey FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1""",
    "prefix_summary_of_titles": f"""WITH {TITLES}
SELECT {PREFIX} AS "Prefix signatury", count(*) AS "Počet titulů" FROM tituly
WHERE TITUL_KEY IN (SELECT l_partkey FROM lineitem) GROUP BY 1""",
    "copies_per_title": (
        "SELECT l_partkey AS TITUL_KEY, count(DISTINCT l_suppkey) AS pocet_svazku FROM lineitem GROUP BY 1"
    ),
    "loans_by_title": f"""WITH {OPS}
SELECT l_partkey AS TITUL_KEY, count(*) FILTER (WHERE is_loan) AS loan_cnt,
       strftime(min(l_shipdate), '%Y-%m-%d') AS first_date, strftime(max(l_shipdate), '%Y-%m-%d') AS last_date
FROM ops GROUP BY 1""",
    "star_schema_views": f"""WITH {OPS}
SELECT l_partkey AS TITUL_KEY, count(DISTINCT l_suppkey) AS pocet_svazku, count(*) FILTER (WHERE popis = 'loan') AS loan_type_cnt,
       strftime(min(l_shipdate), '%Y-%m-%d') AS first_date, strftime(max(l_shipdate), '%Y-%m-%d') AS last_date,
       count(*) FILTER (WHERE is_loan) AS loan_cnt
FROM ops GROUP BY 1""",
    "count_labels": from_metrics(
        """SELECT 'pocet_operaci_v_obdobi' AS sloupec, 'Počet operací v období (celkem)' AS popisek,
       CAST(greatest(max(pocet_operaci_v_obdobi), 1) AS BIGINT) AS nejvyssi FROM m
UNION ALL SELECT 'pocet_vypujcek_is_loan', 'Počet výpůjček (IS_LOAN)', CAST(greatest(max(pocet_vypujcek_is_loan), 1) AS BIGINT) FROM m
UNION ALL SELECT 'pocet_vraceni_is_return', 'Počet vrácení (IS_RETURN)', CAST(greatest(max(pocet_vraceni_is_return), 1) AS BIGINT) FROM m"""
    ),
    "classify_titles": from_classes("SELECT title_key, vyjimka_flag, klasifikace, duvod_oznaceni FROM c"),
    "classify_titles_zero_limit": (
        f"WITH {metrics()}, {classes(stale=3.0, auto_max=0)} "
        "SELECT klasifikace, duvod_oznaceni, count(*) AS n FROM c GROUP BY 1, 2"
    ),
    "exception_flags": """SELECT p_partkey AS TITUL_KEY,
       p_name LIKE 'small%' OR p_name LIKE '%blue %' OR p_type LIKE '%PROMO%' AS vyjimka_flag FROM part""",
    "exception_flags_from_table": """WITH marks AS (SELECT lower(p_type || ' ' || CAST(p_partkey AS VARCHAR)) AS k FROM part WHERE p_size <= 2),
names AS (SELECT DISTINCT trim(lower(substr(p_name, 2, 9))) AS k FROM part WHERE p_size = 50)
SELECT p_partkey AS TITUL_KEY,
       lower(p_brand) IN ('brand#51', 'brand#52')
       OR EXISTS (SELECT 1 FROM marks WHERE contains(lower(p_type || ' ' || CAST(p_partkey AS VARCHAR)), k))
       OR EXISTS (SELECT 1 FROM names WHERE k <> '' AND contains(lower(p_name), k)) AS vyjimka_flag FROM part""",
    "exception_reasons": from_classes(
        """SELECT CASE TITUL_DRUH_DOKUMENTU WHEN 'type economy' THEN 'Beletrie' WHEN 'STANDARD' THEN 'poezie a drama'
              ELSE TITUL_DRUH_DOKUMENTU END AS TITUL_DRUH_DOKUMENTU,
       CASE TITUL_DRUH_DOKUMENTU WHEN 'type economy' THEN 'chráněno výjimkou: beletrie'
            WHEN 'STANDARD' THEN 'chráněno výjimkou: poezie' ELSE duvod_oznaceni END AS duvod_oznaceni, count(*) AS n
FROM c WHERE vyjimka_flag GROUP BY 1, 2"""
    ),
    "rules_table": """SELECT DISTINCT 'TITUL_NAZEV' AS "column", p_name AS keyword FROM part
UNION ALL SELECT DISTINCT 'TITUL_JAZYK', p_brand FROM part""",
    "summary_by_prefix": from_classes(
        "SELECT *, AUTO_KANDIDAT + RUCNI_POSOUZENI + CHRANENO_VYJIMKOU + PONECHAT AS CELKEM_TITULU FROM matrix",
        more=MATRIX,
    ),
    "summary_by_prefix_rolled": from_classes(
        "SELECT *, AUTO_KANDIDAT + RUCNI_POSOUZENI + CHRANENO_VYJIMKOU + PONECHAT AS CELKEM_TITULU FROM matrix",
        more=MATRIX,
    ),
    "kpi_rolled": from_classes(KPI, more=KPI_ROW),
    "titles_by_class_rolled": from_classes(
        'SELECT klasifikace, count(DISTINCT title_key) AS titles, count(*) AS "rows" FROM c GROUP BY 1'
    ),
    "summary_labelled": from_classes(
        """SELECT SIGN_PREFIX AS "Prefix signatury", AUTO_KANDIDAT AS "Automatický kandidát (nízký výskyt)",
       RUCNI_POSOUZENI AS "Ruční posouzení", CHRANENO_VYJIMKOU AS "Chráněno výjimkou", PONECHAT AS "Ponechat",
       AUTO_KANDIDAT + RUCNI_POSOUZENI + CHRANENO_VYJIMKOU + PONECHAT AS "Celkem titulů"
FROM matrix WHERE SIGN_PREFIX = 'ST'""",
        more=MATRIX,
    ),
    "top_auto_prefixes": from_classes(
        "SELECT SIGN_PREFIX, AUTO_KANDIDAT FROM matrix ORDER BY 2 DESC, 1 LIMIT 10", more=MATRIX
    ),
    "kpi_summary": from_classes(KPI, more=KPI_ROW),
    "class_counts": from_classes(
        """SELECT CASE klasifikace WHEN 'AUTO_KANDIDAT' THEN 'Automatický kandidát (nízký výskyt)'
            WHEN 'RUCNI_POSOUZENI' THEN 'Ruční posouzení' WHEN 'CHRANENO_VYJIMKOU' THEN 'Chráněno výjimkou'
            ELSE 'Ponechat' END AS popisek, count(*) AS pocet FROM c GROUP BY 1"""
    ),
    "facet_values": from_classes(
        """SELECT DISTINCT 'SIGN_PREFIX' AS facet, SIGN_PREFIX AS value FROM c
UNION ALL SELECT DISTINCT 'TITUL_JAZYK', TITUL_JAZYK FROM c
UNION ALL SELECT DISTINCT 'TITUL_DRUH_DOKUMENTU', TITUL_DRUH_DOKUMENTU FROM c"""
    ),
    "loan_histogram": from_metrics(
        """SELECT CAST(least(floor((vypujcky_5_let - lo) / ((hi - lo) / CAST(30 AS DOUBLE))), 29) AS INTEGER) AS bin,
       count(*) AS pocet
FROM m, (SELECT min(vypujcky_5_let) AS lo, max(vypujcky_5_let) AS hi FROM m) GROUP BY 1"""
    ),
    "count_filter_bounds": from_metrics(
        """SELECT CAST(greatest(max(pocet_operaci_v_obdobi), 1) AS INTEGER) AS greatest,
       CAST(greatest(max(pocet_operaci_v_obdobi), 1) AS INTEGER) AS cap FROM m"""
    ),
    "top_writeoff": from_classes(
        f"SELECT {CANDIDATE_COLUMNS}, {WRITE_OFF} AS skore_odpis FROM c "
        "ORDER BY skore_odpis DESC, pocet_svazku DESC, title_key LIMIT 50"
    ),
    "top_buy": from_classes(
        f"SELECT {CANDIDATE_COLUMNS}, {BUY} AS skore_dokup FROM c "
        "ORDER BY skore_dokup DESC, vykon_na_svazek DESC, title_key LIMIT 50"
    ),
    "unclear_cases": from_classes(
        f"""SELECT * FROM (SELECT 'hodně svazků + vysoký výkon' AS typ, {CANDIDATE_COLUMNS} FROM c, mid
  WHERE pocet_svazku >= mc AND vykon_na_svazek >= mu ORDER BY pocet_svazku DESC, vykon_na_svazek DESC, title_key LIMIT 25)
UNION ALL
SELECT * FROM (SELECT 'málo svazků + nízký výkon' AS typ, {CANDIDATE_COLUMNS} FROM c, mid
  WHERE pocet_svazku <= mc AND vykon_na_svazek <= mu ORDER BY vykon_na_svazek, pocet_svazku, title_key LIMIT 25)""",
        more="mid AS (SELECT trunc(median(pocet_svazku)) AS mc, median(vykon_na_svazek) AS mu FROM c)",
    ),
    "quantile_thresholds": from_classes(
        """SELECT copies_high, round(use_low, 9) AS use_low, copies_low, round(use_high, 9) AS use_high, max_copies,
       round(max_use, 9) AS max_use FROM ranges""",
        more=RANGES,
    ),
    "recommended_writeoff": from_classes(
        f"""SELECT title_key, pocet_svazku, vykon_na_svazek, {WRITE_OFF} AS skore_odpis FROM c, ranges
WHERE pocet_svazku >= copies_high AND vykon_na_svazek <= use_low
ORDER BY skore_odpis DESC, pocet_svazku DESC, title_key LIMIT 50""",
        more=RANGES,
    ),
    "recommended_buy": from_classes(
        f"""SELECT title_key, pocet_svazku, vykon_na_svazek, {BUY} AS skore_dokup FROM c, ranges
WHERE pocet_svazku <= copies_low AND vykon_na_svazek >= use_high
ORDER BY skore_dokup DESC, vykon_na_svazek DESC, title_key LIMIT 50""",
        more=RANGES,
    ),
    "filtered_titles": from_classes(
        """SELECT title_key, klasifikace, pocet_opid_4, pocet_svazku FROM c
WHERE SIGN_PREFIX IN ('EC', 'PR', 'ST') AND CAST(substr(TITUL_JAZYK, 7) AS INTEGER) BETWEEN 1 AND 15
  AND klasifikace <> 'CHRANENO_VYJIMKOU' AND regexp_matches(TITUL_NAZEV, '(small|large|green)')
  AND pocet_opid_4 <= 2 AND pocet_svazku BETWEEN 5 AND 60 AND vykon_na_svazek <= 0.3""",
        opids=OPIDS,
    ),
    "review_of_written_titles": from_classes(
        """SELECT TITUL_KEY, CAST(7 AS INTEGER) AS okno_let, vypujcky_okno, klasifikace, duvod_oznaceni FROM c
WHERE SIGN_PREFIX = 'PR' AND pocet_svazku >= 5"""
    ),
    "review_titles": from_review("SELECT title_key, klasifikace, duvod_oznaceni, vyjimka_flag FROM sel"),
    "review_summary": from_review(
        "SELECT *, AUTO_KANDIDAT + RUCNI_POSOUZENI + CHRANENO_VYJIMKOU + PONECHAT AS CELKEM_TITULU FROM matrix"
    ),
    "review_kpi": from_review(KPI),
    "review_class_counts": from_review("SELECT klasifikace, count(*) AS pocet FROM sel GROUP BY 1"),
    "review_top_auto": from_review("SELECT SIGN_PREFIX, AUTO_KANDIDAT FROM matrix"),
    "review_write_off": from_review(
        f"SELECT {CANDIDATES_SHOWN} FROM sel ORDER BY {WRITE_OFF} DESC, pocet_svazku DESC, title_key LIMIT 50"
    ),
    "review_buy": from_review(
        f"SELECT {CANDIDATES_SHOWN} FROM sel ORDER BY {BUY} DESC, vykon_na_svazek DESC, title_key LIMIT 50"
    ),
    "review_unclear": from_review(UNCLEAR),
    "labelled_results": from_classes(LABELLED, subjects=True, opids=OPIDS),
    "title_subjects": f"WITH {SUBJECTS} SELECT * FROM subjects",
    "subject_variants": f"""WITH {DESK}, texts AS (
  SELECT t, 'inline ' || ptr AS x FROM desk
  UNION SELECT t, 'via ' || n_name FROM desk JOIN nation ON n_nationkey = ptr)
SELECT t AS TITUL_KEY, '' AS och_subjects, string_agg(x, ' | ' ORDER BY x) AS desk_subjects FROM texts GROUP BY t""",
    "subject_search": from_metrics(
        """SELECT title_key, desk_subjects, och_subjects FROM m
WHERE regexp_matches(desk_subjects, '(NATION_1$|NATION_22)') AND regexp_matches(och_subjects, '(ASIA|EUROPE)')""",
        subjects=True,
    ),
    "subject_fill_rate": from_metrics(
        """SELECT count(*) FILTER (WHERE desk_subjects <> '') AS desk_subjects_vyplneno,
       count(*) FILTER (WHERE och_subjects <> '') AS och_subjects_vyplneno, count(*) AS celkem FROM m""",
        subjects=True,
    ),
    "subject_vocabulary": f"WITH {ALL_TERMS} SELECT term FROM terms",
    "subject_suggestions": f"""WITH {ALL_TERMS}
SELECT term FROM terms WHERE starts_with(lower(term), 'en') ORDER BY lower(term), term LIMIT 80""",
    "dictionary_suggestions": f"""WITH {ALL_TERMS}
SELECT term FROM terms WHERE starts_with(lower(term), 'en') ORDER BY lower(term), term LIMIT 80""",
    "text_search": "SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), '(ouon[,.]|whth)')",
    "title_assembly": f"""WITH {TITLES}
SELECT TITUL_KEY, TITUL_SIGN_FULL, TITUL_NAZEV, TITUL_ZAHLAVI,
       TITUL_ROK_VYDANI, TITUL_JAZYK, TITUL_DRUH_DOKUMENTU FROM tituly""",
    "doc_type_labels": """SELECT p_partkey AS TITUL_KEY,
       CASE WHEN p_type = 'STANDARD' THEN p_type ELSE 'type ' || lower(p_type) END AS TITUL_DRUH_DOKUMENTU FROM part""",
    "reader_demographics": f"WITH {READERS} SELECT * FROM reader_groups",
    "reader_groups_private": f"WITH {READERS} SELECT * EXCLUDE (VEK) FROM reader_groups",
    "enriched_operations": f"WITH {ENRICHED} SELECT * FROM enriched",
    "enriched_from_buckets": f"WITH {ENRICHED} SELECT * FROM enriched",
    "enriched_by_reader_group": f"""WITH {ENRICHED}
SELECT VEK_BUCKET, POHLAVI, ACTION_GROUP, YEAR_MONTH, count(*) AS n FROM enriched GROUP BY 1, 2, 3, 4""",
    "calendar_attributes": """SELECT event_id, strftime(ts, '%Y-%m-%d') AS DATE, CAST(year(ts) AS INTEGER) AS YEAR,
       CAST(month(ts) AS INTEGER) AS MONTH, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS YEAR_MONTH,
       CAST(week(ts) AS INTEGER) AS WEEK, CAST(dayofweek(ts) AS INTEGER) AS WEEKDAY FROM events""",
    "validate_build": f"WITH {REPORT} SELECT * FROM report",
    "ingest_fixed_width": f"""WITH {TITLES}
SELECT * REPLACE (CAST(TITUL_ROK_VYDANI AS VARCHAR) AS TITUL_ROK_VYDANI) FROM tituly""",
    "ingest_operations": f"""WITH {OPS}
SELECT CAST(l_shipdate AS VARCHAR) AS STAT_VYP_TIME, opid AS STAT_VYP_OPID, count(*) AS n,
       CAST(sum(copy_key) AS VARCHAR) AS keys FROM ops GROUP BY 1, 2""",
    "charset_normalise": f"SELECT doc_id, md5(regexp_replace(text, '{CP1250_CLASS}', '?', 'g')) AS digest FROM documents",
    "charset_conversion": f"""WITH lines AS (
  SELECT unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS line FROM documents)
SELECT md5(regexp_replace(line, '{CP1250_CLASS}', '?', 'g')) AS digest, count(*) AS n
FROM lines WHERE line <> '' GROUP BY 1""",
    "export_roundtrip": from_classes(
        """SELECT c.*, m.AUTO_KANDIDAT, m.RUCNI_POSOUZENI, m.CHRANENO_VYJIMKOU, m.PONECHAT,
       m.AUTO_KANDIDAT + m.RUCNI_POSOUZENI + m.CHRANENO_VYJIMKOU + m.PONECHAT AS CELKEM_TITULU
FROM c JOIN matrix m ON m.SIGN_PREFIX = c.SIGN_PREFIX""",
        more=MATRIX,
    ),
    "export_csv": from_classes("SELECT title_key, TITUL_NAZEV, klasifikace, duvod_oznaceni FROM c"),
    "rebuild_report": f"""WITH {REPORT}, {OPS}
SELECT *, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS metrics_titles,
       (SELECT count(*) FROM ops WHERE is_loan
          AND l_shipdate >= (SELECT max(l_shipdate) - INTERVAL 2 YEAR FROM lineitem)) AS metrics_loans
FROM report""",
}
