"""Subject texts of titles: content characteristics (OCH) and descriptors (desk)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.joins import join_code_list
from shelfwise.schema import pick_column, safe_long

JOINER = " | "  # fixed value: between the texts of one title

# Names under which the dumps may hold each role, in order of preference.
OCH_TITLE = ("OCH_PTR_TITUL", "PTR_TITUL", "OCH_TITUL_KEY")
OCH_POINTER = ("OCH_PTR_TXOCH", "OCH_TXOCH_KEY", "OCH_PTR_OCH_TXOCH", "PTR_TXOCH", "TXOCH_KEY")
TXOCH_KEY = ("TXOCH_KEY", "OCH_TXOCH_KEY")
TXOCH_TEXT = ("TXOCH_TEXT", "TXOCH_TXT", "TXOCH_POPIS", "TXOCH_TX_TEXT")
DESK_TITLE = ("DESK_PTR_TITUL", "DESK_TITUL_KEY", "PTR_TITUL", "TITUL_KEY")
DESK_POINTER = (
    "DESK_PTR_TXDESK",
    "DESK_TXDESK_KEY",
    "DESK_PTR_DESKT",
    "DESK_DESKT_KEY",
    "PTR_DESKT",
    "PTR_TXDESK",
    "TXDESK_KEY",
    "DESKT_KEY",
)
DESK_TEXT = ("DESK_TEXT", "DES_TXT", "DESK_POPIS", "TEXT")
TXDESK_KEY = ("TXDESK_KEY", "DESK_KEY", "DESKT_KEY", "TXDESK_PTR_DESKT", "PTR_DESKT")
TXDESK_LINK = ("TXDESK_PTR_DESKT", "DESK_PTR_DESKT", "PTR_DESKT", "DESKT_KEY", "DESK_KEY")
TXDESK_TEXT = ("TXDESK_DESKRIPTOR", "TXDESK_TEXT", "TXDESK_TXT", "DES_TXT", "TXDESK_POPIS", "TEXT")
DESKT_KEY = ("DESKT_KEY", "DESK_KEY", "DESKT_ID")


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))


def _links(table: DataFrame, title: str, pointer: str) -> DataFrame:
    """Distinct (title, pointer) numbers: repeated links go before any text is attached."""
    pairs = table.select(safe_long(table, title).alias("TITUL_KEY"), safe_long(table, pointer).alias("_ptr"))
    return pairs.filter("TITUL_KEY IS NOT NULL").distinct()


def _texts(table: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct texts per key, so that a repeated key cannot blow up the links."""
    return table.select(safe_long(table, key).alias("_ptr"), _text(text).alias("subject_text")).distinct()


def joined_texts(pairs: DataFrame, name: str) -> DataFrame:
    """One row per title with its distinct texts in order, NULL when it has none.

    The texts of a title are made distinct across the cluster first; what meets in one task is the finished value.
    """
    distinct = pairs.distinct()
    joined = F.array_join(F.array_sort(F.collect_list("subject_text")), JOINER)
    return distinct.groupBy("TITUL_KEY").agg(F.nullif(joined, F.lit("")).alias(name))


def och_texts(och: DataFrame | None, txoch: DataFrame | None) -> DataFrame | None:
    if och is None or txoch is None:
        return None
    title, pointer = pick_column(och.columns, OCH_TITLE), pick_column(och.columns, OCH_POINTER)
    key, text = pick_column(txoch.columns, TXOCH_KEY), pick_column(txoch.columns, TXOCH_TEXT)
    if not all((title, pointer, key, text)):
        return None
    pairs = join_code_list(_links(och, title, pointer), _texts(txoch, key, text), "_ptr")
    return joined_texts(pairs.select("TITUL_KEY", "subject_text"), "och_subjects")


def desk_pairs(desk: DataFrame, deskt: DataFrame | None, txdesk: DataFrame | None) -> list[DataFrame]:
    """Every resolvable way from a title to a descriptor text."""
    title, pointer = pick_column(desk.columns, DESK_TITLE), pick_column(desk.columns, DESK_POINTER)
    if not title:
        return []
    out = []
    links = _links(desk, title, pointer) if pointer else None
    tx_columns = txdesk.columns if txdesk is not None else []
    text = pick_column(tx_columns, TXDESK_TEXT)
    if links is not None and text:
        direct = pick_column(tx_columns, TXDESK_KEY)
        if direct:
            out.append(join_code_list(links, _texts(txdesk, direct, text), "_ptr"))
        via = pick_column(deskt.columns, DESKT_KEY) if deskt is not None else None
        link = pick_column(tx_columns, TXDESK_LINK)
        if via and link:
            known = deskt.select(safe_long(deskt, via).alias("_ptr"), F.lit(True).alias("_known")).distinct()
            reached = join_code_list(links, known, "_ptr").withColumn("_ptr", F.when(F.col("_known"), F.col("_ptr")))
            out.append(join_code_list(reached, _texts(txdesk, link, text), "_ptr"))
    inline = pick_column(desk.columns, DESK_TEXT)
    if inline:
        rows = desk.select(safe_long(desk, title).alias("TITUL_KEY"), _text(inline).alias("subject_text"))
        out.append(rows.filter("TITUL_KEY IS NOT NULL"))
    return [p.select("TITUL_KEY", "subject_text") for p in out]


def desk_texts(desk: DataFrame | None, deskt: DataFrame | None, txdesk: DataFrame | None) -> DataFrame | None:
    variants = desk_pairs(desk, deskt, txdesk) if desk is not None else []
    if not variants:
        return None
    pairs = variants[0]
    for other in variants[1:]:
        pairs = pairs.unionByName(other)
    return joined_texts(pairs, "desk_subjects")


def title_subjects(
    och: DataFrame | None = None,
    txoch: DataFrame | None = None,
    desk: DataFrame | None = None,
    deskt: DataFrame | None = None,
    txdesk: DataFrame | None = None,
) -> DataFrame | None:
    """``TITUL_KEY, och_subjects, desk_subjects`` with ``''`` for a missing side; None when nothing can be resolved."""
    och_side, desk_side = och_texts(och, txoch), desk_texts(desk, deskt, txdesk)
    if och_side is None and desk_side is None:
        return None
    if och_side is None:
        return desk_side.select("TITUL_KEY", F.lit("").alias("och_subjects"), "desk_subjects")
    if desk_side is None:
        return och_side.select("TITUL_KEY", "och_subjects", F.lit("").alias("desk_subjects"))
    return och_side.join(desk_side, "TITUL_KEY", "full").select(
        "TITUL_KEY",
        F.coalesce("och_subjects", F.lit("")).alias("och_subjects"),
        F.coalesce("desk_subjects", F.lit("")).alias("desk_subjects"),
    )
