"""Parsing of service payloads kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .keys import is_active, is_zoning_code
from .rules import contains_any

_FIELD = "array<struct<prposAreaDstrcCodeNm:string,prposAreaDstrcCode:string,cnflcAt:string,cnflcAtNm:string,lastUpdtDt:string,registDt:string>>"


def _object_or_null(text: Column) -> Column:
    """JSON text of an object; a string holding an encoded object is unwrapped once."""
    unwrapped = F.when(F.ltrim(text).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"])
    inner = F.coalesce(unwrapped, text)
    return F.when(F.ltrim(inner).startswith("{"), inner)


def _as_list(text: Column) -> Column:
    """JSON array text; a single object becomes a list of one."""
    return F.when(F.ltrim(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))) \
        .when(F.ltrim(text).startswith("["), text)


def parse_designations(df: DataFrame, key: str = "id") -> DataFrame:
    """Designation records of each payload; broken payloads yield one UNAVAILABLE row.

    Accepts encoded objects inside strings, a single record instead of a list, and
    skips entries that are not objects.  Distinct by (code, name, relation code);
    ``updated_at`` of the payload is its latest record date.
    """
    root = _object_or_null(F.col("payload"))
    uses_raw = F.get_json_object(root, "$.landUses")
    uses = F.when(F.ltrim(uses_raw).startswith("{"), uses_raw)
    code = F.get_json_object(uses, "$.resultCode")
    ok = root.isNotNull() & (uses_raw.isNull() | uses.isNotNull()) & (code.isNull() | code.isin("", "OK"))
    raw = F.from_json(_as_list(F.get_json_object(uses, "$.field")), "array<string>")
    # entries are parsed one by one so that a non-object entry only drops itself
    field = F.transform(F.filter(raw, lambda t: F.ltrim(t).startswith("{")), lambda t: F.from_json(t, _FIELD[6:-1]))
    base = df.select("*", ok.alias("_ok"), F.when(ok, field).alias("_f"))
    trim = lambda c: F.trim(F.coalesce(F.col(f"f.{c}"), F.lit("")))
    rows = (base.withColumn("f", F.explode_outer("_f"))
            .select(*[c for c in df.columns if c != "payload"], "_ok", trim("prposAreaDstrcCodeNm").alias("name"),
                    trim("prposAreaDstrcCode").alias("code"), trim("cnflcAt").alias("relation_code"),
                    trim("cnflcAtNm").alias("relation"), F.col("f.lastUpdtDt").alias("updated_at")))
    status = F.when(F.col("_ok"), "AVAILABLE").otherwise("UNAVAILABLE")
    keys = [c for c in df.columns if c != "payload"]
    kept = rows.filter((F.col("name") != "") | ~F.col("_ok"))
    return (kept.groupBy(*keys, status.alias("status"), "code", "name", "relation_code")
            .agg(F.max("relation").alias("relation"), F.max("updated_at").alias("updated_at"))
            .withColumns({"active": is_active(F.col("relation_code"), F.col("relation")), "is_zoning": is_zoning_code(F.col("code"))}))


def classify_owner(name: Column) -> Column:
    """Public tokens are tested before private ones."""
    return F.when(name.isNotNull(), F.when(contains_any(name, fv.PUBLIC_OWNER_TOKENS), "국공유")
                  .when(contains_any(name, fv.PRIVATE_OWNER_TOKENS), "사유"))


def parse_ownership(df: DataFrame) -> DataFrame:
    """Owner class of each payload: the exact field first, else the first value naming an owner.

    Works on the text so the field is found at any depth.
    """
    exact = F.regexp_extract("payload", r'"posesnSeCodeNm"\s*:\s*"\s*([^"]*[^"\s])\s*"', 1)
    values = F.regexp_extract_all("payload", F.lit(r':\s*"([^"]*)"'), 1)
    tokens = fv.PUBLIC_OWNER_TOKENS + fv.PRIVATE_OWNER_TOKENS
    loose = F.get(F.filter(values, lambda v: contains_any(v, tokens)), F.lit(0))
    df = df.withColumn("owner_name", F.coalesce(F.when(exact != "", exact), F.trim(loose)))
    return df.withColumn("ownership", classify_owner(F.col("owner_name")))


_ITEM = ("array<struct<bldNm:string,dongNm:string,mainPurpsCdNm:string,strctCdNm:string,grndFlrCnt:int,ugrndFlrCnt:int,"
         "archArea:double,totArea:double,useAprDay:string>>")


def parse_register(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Building rows, and per payload FOUND/CLEAR with the reported (else counted) total."""
    items = F.from_json(_as_list(F.get_json_object("payload", "$.response.body.items.item")), _ITEM)
    total = F.get_json_object("payload", "$.response.body.totalCount").cast("int")
    base = df.withColumns({"_i": F.coalesce(items, F.array().cast(_ITEM)), "_t": total})
    n = F.size("_i")
    summary = base.select(*[c for c in df.columns if c != "payload"], F.when(n > 0, "FOUND").otherwise("CLEAR").alias("status"),
                          F.when(F.coalesce("_t", F.lit(0)) != 0, F.col("_t")).otherwise(n).alias("count"))
    rows = (base.withColumn("b", F.explode("_i"))
            .select(*[c for c in df.columns if c != "payload"],
                    F.trim(F.coalesce(F.nullif(F.col("b.bldNm"), F.lit("")), F.nullif(F.col("b.dongNm"), F.lit("")), F.lit("건축물"))).alias("building"),
                    F.trim(F.coalesce("b.dongNm", F.lit(""))).alias("dong"), F.col("b.totArea").alias("floor_area")))
    return rows, summary
