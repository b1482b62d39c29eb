"""Gap-only fills from second opinions: model answers, entities, organisations and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens import fixed_values as fv
from packlens.functions.dates import parse_label_date
from packlens.functions.text import ci, digit_count, first_match, letters, lines_of, plain_number, short_number, stage, strip

TEXT_FIELDS = ("manufacturer_name", "manufacturer_address", "generic_name", "consumer_care", "country_of_origin")


def model_patch_parse(answers: DataFrame) -> DataFrame:
    """Model answer text to typed patch columns ``p_*``; anything malformed becomes null.

    JSON types are checked, so ``true`` is no number and ``"12"`` is no price.
    """
    raw = strip(F.coalesce("answer", F.lit("")))
    bare = F.array_join(F.filter(lines_of(raw), lambda s: ~F.startswith(strip(s), F.lit("```"))), "\n")
    df = stage(answers, __v=F.try_parse_json(F.when(raw.startswith("```"), bare).otherwise(raw)))

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("__v", f"$.{name}", "variant")), F.lit(""))

    def number(name: str) -> Column:
        value = F.try_variant_get("__v", f"$.{name}", "double")
        return F.when(kind(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (value > 0), value)

    def words(name: str) -> Column:
        return F.when(kind(name) == "STRING", strip(F.try_variant_get("__v", f"$.{name}", "string")))

    def flag(name: str) -> Column:
        return F.when(kind(name) == "BOOLEAN", F.try_variant_get("__v", f"$.{name}", "boolean"))

    unit = F.regexp_replace(F.lower(words("net_quantity_unit")), "s+$", "")
    cols = {
        "p_mrp": number("mrp"), "p_mrp_includes_taxes": flag("mrp_includes_taxes"),
        "p_net_quantity_value": number("net_quantity_value"),
        "p_net_quantity_unit": F.when(unit.isin(*fv.MODEL_UNITS), unit),
        "p_mfg_date": parse_label_date(words("mfg_date")), "p_expiry_date": parse_label_date(words("expiry_date")),
        "p_is_imported": flag("is_imported"),
        **{f"p_{f}": F.nullif(F.substring(words(f), 1, 300), F.lit("")) for f in TEXT_FIELDS},
    }
    return df.select("scan_id", *[v.alias(k) for k, v in cols.items()])


def digits_grounded(value: Column, text: Column) -> Column:
    """Do the digits of a number occur in the printed digits?"""
    digits = F.regexp_replace(short_number(value), r"\D", "")
    return (digits != "") & F.contains(F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", ""), digits)


def model_patch_fill(decl: DataFrame, patches: DataFrame) -> DataFrame:
    """Fill gaps of a declaration from a patch, guarded; ``filled`` lists what was accepted.

    ``decl`` carries ``ocr_text``. Numbers must be printed, names must not be headings, care needs a
    contact, and a pair of dates must be in order.
    """
    df = decl.join(patches, "scan_id", "left")
    text = F.col("ocr_text")
    fields = ("mrp", "mrp_includes_taxes", "net_quantity_value", "net_quantity_unit", "mfg_date", "expiry_date",
              *TEXT_FIELDS, "is_imported")
    kinds = dict(decl.dtypes)

    def gap(f: str) -> Column:
        c = F.col(f)
        return c.isNull() | (c == "") if kinds[f] == "string" else (~F.coalesce(c, F.lit(False)) if kinds[f] == "boolean" else c.isNull())

    def offered(f: str) -> Column:
        p = F.col(f"p_{f}")
        return F.when(p != "", p) if kinds[f] == "string" else (F.when(p, p) if kinds[f] == "boolean" else p)

    guards = {
        "mrp": lambda p: digits_grounded(p, text), "net_quantity_value": lambda p: digits_grounded(p, text),
        "generic_name": lambda p: ~p.rlike(ci(fv.P_HEADING_FILL)),
        "manufacturer_name": lambda p: ~p.rlike(ci(fv.P_CARE_FILL)), "manufacturer_address": lambda p: ~p.rlike(ci(fv.P_CARE_FILL)),
        "consumer_care": lambda p: p.rlike(ci(fv.P_CONTACT)),
    }
    fills = {f"f_{f}": F.when(gap(f) & guards.get(f, lambda _: F.lit(True))(offered(f)), offered(f)) for f in fields}
    df = df.withColumns(fills)
    reversed_pair = F.coalesce(F.col("f_expiry_date") <= F.col("f_mfg_date"), F.lit(False))
    df = df.withColumns({f: F.when(~reversed_pair, F.col(f)) for f in ("f_mfg_date", "f_expiry_date")})
    filled = F.array_compact(F.array(*[F.when(F.col(f"f_{f}").isNotNull(), F.lit(f)) for f in sorted(fields)]))
    df = df.withColumn("filled", filled)
    return df.withColumns({
        **{f: F.coalesce(F.when(F.col(f"f_{f}").isNotNull(), F.col(f"f_{f}")), F.col(f)) for f in fields},
        "field_sources": mark_sources(F.col("field_sources"), F.col("filled"), "ai_assist"),
    }).select(*decl.columns, "filled")


def mark_sources(sources: Column, fields: Column, mark: str) -> Column:
    """Provenance of newly filled fields; marks that exist stay."""
    new = F.array_except(fields, F.map_keys(sources))
    return F.map_concat(sources, F.map_from_arrays(new, F.transform(new, lambda _: F.lit(mark))))


def first_entities(entities: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """First entity text per scan and label, one column per label; a conditional aggregate, no pivot."""
    picks = [F.min_by(F.when(F.col("label") == lab, F.col("text")), F.when(F.col("label") == lab, F.col("pos"))).alias(f"e_{lab}") for lab in labels]
    return entities.where(F.col("label").isin(*labels)).groupBy("scan_id").agg(*picks)


def entity_fill(decl: DataFrame, entities: DataFrame) -> DataFrame:
    """Fill gaps from tagged entities; each label has its own guard. ``decl`` carries ``ocr_text``."""
    labels = ("MRP", "NET_QTY", "MFG_DATE", "EXP_DATE", "MANUFACTURER", "CARE")
    df = decl.join(first_entities(entities, labels), "scan_id", "left")
    ent = F.col("e_MRP")
    line = F.coalesce(F.get(F.filter(lines_of(F.col("ocr_text")), lambda s: (ent != "") & F.contains(s, ent)), 0), F.lit(""))
    df = stage(df, __line=line, __price=plain_number(first_match(ent, r"([\d,]+(?:\.\d{1,2})?)")))
    cued = ent.rlike(ci(fv.P_ENTITY_PRICE)) | (F.col("__line").rlike(ci(fv.P_PRICE_CUE)) & ~F.col("__line").rlike(ci(fv.P_MRP_POISON)))
    qty = plain_number(first_match(F.col("e_NET_QTY"), ci(fv.P_ENTITY_QTY)))
    unit = F.regexp_replace(F.lower(first_match(F.col("e_NET_QTY"), ci(fv.P_ENTITY_QTY), 2)), "s+$", "")
    maker, care = F.col("e_MANUFACTURER"), F.col("e_CARE")
    no_qty = F.col("net_quantity_value").isNull() | ~F.coalesce(F.col("net_quantity_unit") != "", F.lit(False))
    take_qty = no_qty & (qty > 0)
    fills = {
        "mrp": F.when((F.col("__price") > 0) & cued, F.col("__price")),
        "mfg_date": parse_label_date(first_match(F.col("e_MFG_DATE"), "(?U)" + fv.P_ENTITY_MFG)),
        "expiry_date": parse_label_date(first_match(F.col("e_EXP_DATE"), "(?U)" + fv.P_ENTITY_EXP)),
        "manufacturer_name": F.when(maker.rlike(ci(fv.P_ADDRESS_WORD)) & (digit_count(maker) <= letters(maker)), F.substring(maker, 1, 160)),
        "consumer_care": F.when(care.rlike(ci(fv.P_CONTACT)), F.substring(care, 1, 300)),
    }
    out = {f: F.coalesce(F.col(f), v) for f, v in fills.items()}
    out["net_quantity_value"] = F.when(take_qty, qty).otherwise(F.col("net_quantity_value"))
    out["net_quantity_unit"] = F.when(take_qty, unit).otherwise(F.col("net_quantity_unit"))
    filled = df.select(*[c for c in decl.columns if c not in out], *[v.alias(k) for k, v in out.items()])
    now = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in out]))
    return filled.withColumn("field_sources", mark_sources(F.col("field_sources"), now, "inferred")).select(*decl.columns)


def org_place_fill(decl: DataFrame, entities: DataFrame) -> DataFrame:
    """First organisation fills a missing maker, first place a missing origin."""
    df = decl.join(first_entities(entities, ("ORG", "GPE")), "scan_id", "left")

    def fill(field: str, entity: str, size: int) -> Column:
        return F.coalesce(F.nullif(F.col(field), F.lit("")), F.substring(F.col(entity), 1, size))

    return df.withColumns({"manufacturer_name": fill("manufacturer_name", "e_ORG", 160),
                           "country_of_origin": fill("country_of_origin", "e_GPE", 60)}).select(*decl.columns)


def source_trigger(findings: DataFrame) -> DataFrame:
    """Scans that deserve a second opinion: a weak read or a failed key declaration."""
    failed = F.col("status").isin(fv.FAIL, fv.NOT_FOUND) & F.col("rule_id").isin(*fv.SECOND_OPINION_RULES)
    weak = F.coalesce(F.col("ocr_confidence") < fv.SECOND_OPINION_CONFIDENCE, F.lit(False))
    return findings.groupBy("scan_id").agg(F.bool_or(failed | weak).alias("wanted")).where("wanted").select("scan_id")


def with_gaps(decl: DataFrame) -> DataFrame:
    """The declarations that visual rows could fill."""
    return decl.where("mrp IS NULL OR mfg_date IS NULL OR expiry_date IS NULL OR manufacturer_name IS NULL")


def layout_rescue(decl: DataFrame, lines: DataFrame) -> DataFrame:
    """Gap-only fill from visual rows: price below its keyword, dates on or below anchors, maker block.

    Only scans with a gap take part. The rows of a scan, in reading order, come to its declaration as one array, so every look at them is a step inside the row.
    """
    from packlens.functions.fields import GATED_NUTRITION, extract_maker, first_where
    from packlens.functions.text import all_matches, cs
    from packlens.functions.dates import parse_label_dates

    gaps = with_gaps(decl).select("scan_id")
    order = ("y0", "x0", "first_ord")
    own = lines.join(gaps, "scan_id", "left_semi").groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(*order, "text", "y1"))).alias("__rows"))
    df = decl.join(own, "scan_id", "left")
    rows = F.col("__rows")

    def place(r: Column) -> Column:
        return F.struct(*[r[c].alias(c) for c in order])

    def anchor(pattern: str) -> Column:
        return first_where(rows, df.schema["__rows"].dataType.elementType, lambda r: r["text"].rlike(pattern))

    def below(a: Column, k: int) -> Column:
        return F.slice(F.filter(rows, lambda r: (place(r) > place(a)) & (r["y0"] >= a["y1"] - 2)), 1, k)

    def said(a: Column) -> Column:
        here = F.array_sort(F.transform(F.filter(rows, lambda r: place(r) == place(a)), lambda r: r["text"]))
        return F.when(a.isNotNull(), F.concat(here, F.transform(below(a, 1), lambda r: r["text"]))).otherwise(F.array().cast("array<string>"))

    def price(r: Column) -> Column:
        ok = ~r["text"].rlike(ci(fv.P_MRP_POISON)) & ~r["text"].rlike(ci(GATED_NUTRITION))
        return F.when(ok, plain_number(first_match(strip(r["text"]), cs(fv.P_MRP_AMOUNT_LINE))))

    no_name, no_date = F.col("manufacturer_name").isNull(), F.col("mfg_date").isNull() | F.col("expiry_date").isNull()
    df = stage(df, __mrp=F.when(F.col("mrp").isNull(), anchor(ci(fv.P_MRP_KEYWORD))), __mfg=F.when(no_date, anchor(ci(fv.P_MFG_LINE))), __exp=F.when(no_date, anchor(ci(fv.P_EXP_LINE))))
    dated = F.filter(F.concat(said(F.col("__mfg")), said(F.col("__exp"))), lambda t: ~t.rlike(ci(GATED_NUTRITION)))
    prices = F.transform(below(F.col("__mrp"), 2), price)
    df = stage(df, r_mrp=F.when(F.col("__mrp").isNotNull(), F.get(F.filter(prices, lambda p: p > 0), 0)),
               __tokens=F.when(no_date, F.array_distinct(F.flatten(F.transform(dated, lambda t: all_matches(t, "(?U)" + fv.P_DATE_SHAPE))))),
               r_maker=F.when(no_name, extract_maker(F.transform(rows, lambda r: r["text"]))))
    df = stage(df, r_dates=F.array_compact(parse_label_dates(F.col("__tokens"))))
    mfg = F.coalesce("mfg_date", F.get("r_dates", 0))
    later = F.get(F.filter("r_dates", lambda x: x > mfg), 0)
    out = {
        "mrp": F.coalesce("mrp", "r_mrp"), "mfg_date": mfg, "expiry_date": F.coalesce("expiry_date", later),
        "manufacturer_address": F.when(no_name, F.coalesce("manufacturer_address", "r_maker.address")).otherwise(F.col("manufacturer_address")),
        "manufacturer_name": F.coalesce("manufacturer_name", "r_maker.name"),
    }
    filled = df.select(*[c for c in decl.columns if c not in out], *[v.alias(k) for k, v in out.items()])
    now = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in out]))
    return filled.withColumn("field_sources", mark_sources(F.col("field_sources"), now, "inferred")).select(*decl.columns)
