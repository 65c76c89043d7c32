"""Rule joins: use matrix, keyword constraints, setbacks, land category, lot size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import code_table


def first_match(text: Column, pairs: list[tuple[str, object]], otherwise=None) -> Column:
    """Value of the first keyword (list order) contained in ``text``."""
    if not pairs:
        return F.lit(otherwise)
    chain = reduce(lambda acc, p: acc.when(F.contains(text, F.lit(p[0])), F.lit(p[1])), pairs[1:],
                   F.when(F.contains(text, F.lit(pairs[0][0])), F.lit(pairs[0][1])))
    return chain.otherwise(F.lit(otherwise))


def contains_any(text: Column, terms: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms]), F.lit(False))


def use_matrix(spark: SparkSession) -> DataFrame:
    rows = [(use, zone, status) for use, (ok, cond) in fv.USE_MATRIX.items()
            for status, zones in (("allowed", ok), ("conditional", cond)) for zone in zones]
    return code_table(spark, rows, "building_use string, zone string, matrix_status string")


def use_verdict(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """Verdict of (building_use, zone); needs ``found`` and ``n_constraints`` columns.

    Limits not found → unknown before the matrix is consulted; the generic use is
    conditional; uses outside the matrix are unknown; a constraint makes it conditional.
    """
    joined = df.join(matrix, ["building_use", "zone"], "left")
    base = (F.when(~F.col("found"), "unknown").when(F.col("building_use") == fv.GENERIC_USE, "conditional")
            .when(~F.col("building_use").isin(*fv.USE_MATRIX), "unknown")
            .otherwise(F.coalesce("matrix_status", F.lit("not_allowed"))))
    return joined.withColumn("verdict", F.when((F.col("n_constraints") > 0) & base.isin("allowed", "conditional"),
                                               "conditional").otherwise(base)).drop("matrix_status")


def uses_for_zone(zones: DataFrame, matrix: DataFrame) -> DataFrame:
    """Uses per status for each distinct zone (the inverse of the matrix)."""
    order = {use: n for n, use in enumerate(fv.USE_MATRIX)}
    uses = F.explode(F.array(*[F.struct(F.lit(u).alias("building_use"), F.lit(n).alias("use_order")) for u, n in order.items()]))
    grid = zones.select("zone").distinct().select("zone", uses.alias("u")).select("zone", "u.*")
    rated = grid.join(matrix, ["building_use", "zone"], "left").withColumn(
        "status", F.coalesce("matrix_status", F.lit("not_allowed")))
    pick = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("status") == s, F.struct("use_order", "building_use")))), lambda x: x["building_use"]), ",").alias(s)
    return rated.groupBy("zone").agg(pick("allowed"), pick("conditional"), pick("not_allowed"))


def _literal_array(rows: list[str]) -> str:
    return f"array({', '.join(rows)})"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def constraints(df: DataFrame, names: str = "districts", facility: str = "facility_text") -> DataFrame:
    """Constraint notes of an ordered district list as array ``constraints`` of (name, note).

    A fold over the list: for each district the first keyword whose note is still unused
    decides; a facility-scoped keyword that does not apply ends that district.
    """
    kws = []
    for kw, note in fv.CONSTRAINT_KEYWORDS:
        scope = fv.FACILITY_SCOPE.get(kw)
        applies = "true" if not scope else "(" + " OR ".join(f"contains({facility}, {_quote(t)})" for t in scope) + ")"
        kws.append(f"named_struct('kw', {_quote(kw)}, 'note', {_quote(note)}, 'ok', {applies})")
    empty = "cast(array() as array<struct<name:string,note:string>>)"
    hit = ("get(filter(kws, k -> contains(d, k.kw) AND NOT exists(acc, u -> u.note = k.note)), 0)")
    fold = (f"aggregate({names}, {empty}, (acc, d) -> transform(array({hit}), h -> CASE WHEN h IS NOT NULL AND h.ok "
            f"THEN concat(acc, array(named_struct('name', d, 'note', h.note))) ELSE acc END)[0])")
    return (df.withColumn("kws", F.expr(_literal_array(kws)))
            .withColumn("constraints", F.expr(fold)).drop("kws"))


def rules_by_jurisdiction(rules: DataFrame) -> DataFrame:
    """The rule list of each jurisdiction in evaluation order (tens of rules at most)."""
    cols = [c for c in rules.columns if c != "jurisdiction"]
    first = ["rule_order"] + [c for c in cols if c != "rule_order"]
    return rules.groupBy("jurisdiction").agg(F.array_sort(F.collect_list(F.struct(*first))).alias("rules"))


_RULE_TEST = """
 (r.min_gross IS NULL OR coalesce(gross, 0D) >= r.min_gross)
 AND (r.max_gross_excl IS NULL OR coalesce(gross, 0D) < r.max_gross_excl)
 AND (r.zone IS NULL OR coalesce(zone, '') = r.zone)
 AND (r.zone_contains IS NULL OR contains(coalesce(zone, ''), r.zone_contains))
 AND (r.zone_not_contains IS NULL OR NOT contains(coalesce(zone, ''), r.zone_not_contains))
 AND (r.not_zone_in IS NULL OR NOT array_contains(split(r.not_zone_in, '[|]'), coalesce(zone, '')))
 AND (r.zone_in IS NULL OR array_contains(split(r.zone_in, '[|]'), coalesce(zone, '')))"""


def setbacks(df: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching setback rule for (jurisdiction, building_use, zone, gross).

    Rules of the exact use come before the common "*" rules.  A jurisdiction without
    rules is NOT_COLLECTED with nulls; a collected one without a match is 0 m, APPLIED.
    """
    own = f"filter(rules, r -> r.use = building_use AND {_RULE_TEST})"
    common = f"filter(rules, r -> r.use = '*' AND {_RULE_TEST})"
    hit = df.join(rules_by_jurisdiction(rules), "jurisdiction", "left").withColumn(
        "hit", F.expr(f"coalesce(get({own}, 0), get({common}, 0))"))
    sub = F.coalesce(F.col("hit.needs_subtype"), F.lit(False))
    status = F.when(F.col("rules").isNull(), "NOT_COLLECTED").when(sub, "NEEDS_SUBTYPE").otherwise("APPLIED")
    value = lambda c: F.when(F.col("setback_status") == "APPLIED", F.coalesce(F.col(f"hit.{c}").cast("double"), F.lit(0.0)))
    return (hit.withColumn("setback_status", status)
            .withColumns({"front_m": value("front_m"), "adjacent_m": value("adjacent_m"),
                          "preview_front_m": F.when(sub, F.col("hit.preview_front_m").cast("double")),
                          "preview_adjacent_m": F.when(sub, F.col("hit.preview_adjacent_m").cast("double")),
                          "rule_order": F.col("hit.rule_order").cast("int")}).drop("rules", "hit"))


def applicable_setbacks(df: DataFrame, rules: DataFrame, exclude_own: bool = False) -> DataFrame:
    """Setbacks of every use the jurisdiction regulates, at this zone and size; zero rows dropped."""
    uses = rules.select("jurisdiction", "use").distinct()
    per_use = (df.withColumnRenamed("building_use", "own_use").join(uses, "jurisdiction")
               .withColumnRenamed("use", "building_use"))
    if exclude_own:
        per_use = per_use.filter(F.col("building_use") != F.col("own_use"))
    out = setbacks(per_use, rules)
    return out.filter((F.col("setback_status") == "NEEDS_SUBTYPE") | (F.col("front_m") > 0) | (F.col("adjacent_m") > 0))


def classify_jimok(df: DataFrame, col: str = "jimok") -> DataFrame:
    """Land category: full name, class, whether conversion is needed, layers to check."""
    codes = F.create_map(*[F.lit(x) for kv in fv.JIMOK_CODES.items() for x in kv])
    code = F.trim(F.coalesce(F.col(col), F.lit("")))
    name = F.coalesce(F.element_at(codes, code), code)
    cat = (F.when(name == "", "unknown").when(name.isin(*fv.JIMOK_FARMLAND), "farmland")
           .when(name.isin(*fv.JIMOK_FOREST), "forest").when(name.isin(*fv.JIMOK_BUILDABLE), "buildable").otherwise("other"))
    df = df.withColumns({"jimok_name": F.when(name != "", name), "category": cat})
    layers = (F.when(F.col("category") == "farmland", ",".join(fv.JIMOK_CHECK_LAYERS["farmland"]))
              .when(F.col("category") == "forest", ",".join(fv.JIMOK_CHECK_LAYERS["forest"])).otherwise(""))
    return df.withColumns({
        "requires_conversion": F.when(F.col("category") != "unknown", F.col("category").isin("farmland", "forest")),
        "check_layers": layers})


def minimum_lot(zone: Column) -> Column:
    return first_match(zone, list(fv.MIN_LOT_M2.items()), fv.MIN_LOT_OTHER_M2)


def min_lot(df: DataFrame) -> DataFrame:
    """Minimum lot size of the zone and whether the parcel is below it (unknown area: no finding)."""
    df = df.withColumn("min_lot_m2", minimum_lot(F.col("zone")))
    area = F.coalesce(F.col("area_m2"), F.lit(0.0))
    return df.withColumn("below_min_lot", (area != 0) & (area < F.col("min_lot_m2")))


def facility_verdict(df: DataFrame) -> DataFrame:
    """Farmland rule for two kinds of huts; needs ``facility`` and ``category``."""
    fac = F.trim(F.coalesce(F.col("facility"), F.lit("")))
    farm = (fac != "") & (F.col("category") == "farmland")
    return df.withColumn("facility_verdict", F.when(farm & fac.contains("움막"), "not_allowed")
                         .when(farm & fac.contains("농막"), "conditional"))


def plan_evidence(df: DataFrame, sources: DataFrame) -> DataFrame:
    """District-plan documents for parcels designated as such; needs ``districts`` array.

    The jurisdiction match (either name is a suffix of the other) is resolved on the
    distinct jurisdictions by equi-joining their suffixes, then carried to the parcels.
    """
    suffixes = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), i, F.length(c)))
    jur = df.select("jurisdiction").distinct().filter(F.length("jurisdiction") > 0)
    orgs = sources.groupBy("org").agg(F.min("source_no").alias("pos"))
    forward = jur.withColumn("org", F.explode(suffixes("jurisdiction"))).join(orgs, "org")
    back = orgs.withColumn("jurisdiction", F.explode(suffixes("org"))).join(jur, "jurisdiction")
    chosen = (forward.select("jurisdiction", "org", "pos").unionByName(back.select("jurisdiction", "org", "pos"))
              .groupBy("jurisdiction").agg(F.min(F.struct("pos", "org")).alias("b"))
              .select("jurisdiction", F.col("b.org").alias("org")))
    has_plan = F.exists("districts", lambda d: d.contains("지구단위계획"))
    context = F.concat_ws(" ", "address", "pnu", F.array_join("districts", " "))
    hits = (df.filter(has_plan).withColumn("context", context).join(chosen, "jurisdiction").join(sources, "org"))
    return (hits.filter(F.exists(F.split("terms", "[|]"), lambda t: (F.length(F.trim(t)) > 0) & F.contains(F.col("context"), F.trim(t))))
            .withColumn("verification", F.when(F.col("needs_check"), "LATEST_NOTICE_CHECK_REQUIRED").otherwise("VERIFIED")))


def use_restriction(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """Whether a colloquial use in the request can be built in the zone at all.

    The first listed term in the request decides.  Blocked only when none of the uses it
    may mean is buildable; shop-like terms are exempt while the small-shop use is.
    """
    per_zone = (matrix.groupBy("zone").agg(F.collect_set("building_use").alias("buildable")))
    q = F.coalesce(F.col("request"), F.lit(""))
    term = first_match(q, [(t, t) for t, _ in fv.AMBIGUOUS_USE_TERMS])
    cands = first_match(q, [(t, "|".join(c)) for t, c in fv.AMBIGUOUS_USE_TERMS])
    j = df.join(per_zone, "zone", "left").withColumns({"_t": term, "_c": F.split(cands, "[|]"),
                                                      "buildable": F.coalesce("buildable", F.array().cast("array<string>"))})
    all_uses = F.array(*[F.lit(u) for u in fv.USE_MATRIX])
    special = (F.col("zone") == "제1종전용주거지역") & contains_any(q, ["원룸", "다가구", "다중주택"])
    shop_ok = F.col("_t").isin(*fv.SHOP_TERMS) & F.array_contains("buildable", "제1종근린생활시설")
    blocked = F.array_intersect(F.col("_c"), F.array_except(all_uses, F.col("buildable")))
    bad = F.col("_t").isNotNull() & ~shop_ok & ~F.arrays_overlap("_c", "buildable") & (F.size(blocked) > 0)
    kind = F.when(special, "verification_required").when(bad, "blocked")
    return j.withColumns({
        "restriction": kind,
        "term": F.when(special, "다가구·원룸").when(bad, F.col("_t")),
        "blocked": F.when(~special & bad, F.array_join(blocked, "·")).otherwise("")}).drop("_t", "_c", "buildable")
