"""Business labels of columns, classes and operation codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPID_COUNT_PREFIX = "pocet_opid_"

# Label of each class.
CLASS_LABELS = {
    "AUTO_KANDIDAT": "Automatický kandidát (nízký výskyt)",
    "RUCNI_POSOUZENI": "Ruční posouzení",
    "CHRANENO_VYJIMKOU": "Chráněno výjimkou",
    "PONECHAT": "Ponechat",
}
CLASS_COLUMN_LABEL = "Klasifikace"

# Label of each column.
COLUMN_LABELS = {
    "title_key": "Interní klíč titulu",
    "TITUL_NAZEV": "Název titulu",
    "SIGN_PREFIX": "Prefix signatury",
    "TITUL_SIGN_FULL": "Signatura",
    "TITUL_KEY": "ID titulu",
    "TITUL_DRUH_DOKUMENTU": "Druh dokumentu",
    "TITUL_JAZYK": "Jazyk",
    "TITUL_ROK_VYDANI": "Rok vydání",
    "okno_let": "Délka sledovaného období (roky)",
    "vypujcky_okno": "Počet výpůjček v období (pro výkon)",
    "vypujcky_5_let": "Počet výpůjček v období (pro výkon)",
    "pocet_operaci_v_obdobi": "Počet všech operací ve zvoleném období",
    "pocet_vypujcek_is_loan": "Počet výpůjček (IS_LOAN)",
    "pocet_vraceni_is_return": "Počet vrácení (IS_RETURN)",
    "pocet_svazku": "Počet svazků na titul",
    "vykon_na_svazek": "Výkon na svazek (výpůjčky / svazek)",
    "datum_posledni_vypujcky": "Datum poslední výpůjčky",
    "roky_od_posledni_vypujcky": "Roky od poslední výpůjčky",
    "percentil_v_signature": "Percentil v rámci prefixu signatury",
    "relativni_pozice_v_signature": "Pořadí / počet titulů ve stejném prefixu",
    "rizikove_skore": "Rizikové skóre",
    "bez_vypujcek": "Bez výpůjček v období",
    "bez_svazku": "Bez svazku v datech",
    "duvod_oznaceni": "Důvod označení",
    "desk_subjects": "Deskriptory (obsah)",
    "och_subjects": "Obsahová charakteristika (OCH)",
    "vyjimka_flag": "Spadá pod výjimku (pravidla)",
    "typ": "Typ případu",
    "opid": "OPID",
    "popis": "Popis operace (OPIDY)",
}

# Labels of the summaries per shelf-mark prefix.
SUMMARY_LABELS = {"SIGN_PREFIX": "Prefix signatury", **CLASS_LABELS, "CELKEM_TITULU": "Celkem titulů"}
PREFIX_LABELS = {"SIGN_PREFIX": "Prefix signatury", "TITULU": "Počet titulů"}
OPID_COLUMN_LABEL = "Počet operací (OPID {})"

# Descriptions of operation codes used when the data has none.
OPID_DESCRIPTIONS = {
    4: "Abs. půjčování (načtení)",
    5: "Abs. vrácení",
    94: "S. prez. půjčování (načtení)",
    95: "Prez. vrácení",
    97: "Prez. půjčování (načtení)",
    98: "Prez. vrácení",
    225: "Abs. půjčování (načtení)",
    226: "Abs. vrácení",
}

# Filter labels of the three operation counts.
COUNT_LABELS = {
    "pocet_operaci_v_obdobi": "Počet operací v období (celkem)",
    "pocet_vypujcek_is_loan": "Počet výpůjček (IS_LOAN)",
    "pocet_vraceni_is_return": "Počet vrácení (IS_RETURN)",
}

# Texts that stand for a missing description.
EMPTY_DESCRIPTIONS = ("", "nan", "none", "null")


def lookup(mapping: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(mapping.items()))), key)


def class_label(code: Column) -> Column:
    return F.coalesce(lookup(CLASS_LABELS, code), code)


def column_label(name: str) -> str:
    if name.startswith(OPID_COUNT_PREFIX):
        return OPID_COLUMN_LABEL.format(name.removeprefix(OPID_COUNT_PREFIX))
    return COLUMN_LABELS.get(name, name)


def labelled(df: DataFrame) -> DataFrame:
    """Frame with readable column names; the class code becomes a readable last column."""
    out = [F.col(c).alias(column_label(c)) for c in df.columns if c != "klasifikace"]
    if "klasifikace" in df.columns:
        out.append(class_label(F.col("klasifikace")).alias(CLASS_COLUMN_LABEL))
    return df.select(*out)


def labelled_summary(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in SUMMARY_LABELS.items() if k in df.columns})


def labelled_prefixes(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in PREFIX_LABELS.items() if k in df.columns})


def opid_label(opid: Column, description: Column) -> Column:
    """``description (OPID n)``: from the data, else the built-in text, else ``OPID n``."""
    text = F.trim(description)
    known = F.when(~F.lower(text).isin(*EMPTY_DESCRIPTIONS), text)
    code = F.concat(F.lit("OPID "), opid.cast("string"))
    described = F.concat(F.coalesce(known, lookup(OPID_DESCRIPTIONS, opid.cast("int"))), F.lit(" ("), code, F.lit(")"))
    return F.coalesce(described, code)
