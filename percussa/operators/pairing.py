"""Pairing suppressed strings with references, comparability rules, insertion loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percussa.functions import air
from percussa.functions import levels as L
from percussa.operators.ordered import numbered
from percussa.operators.strings import first_round_pop_across
from percussa.session import checkpointed

# Fixed weights of the agreeing fields, and fixed tolerances.
SCORE_FIELDS = {"mic_distance_m": 4, "mic_angle_deg": 4, "mic_model": 2, "mic_serial": 1, "location": 2,
                "date": 2, "operator": 1, "windscreen": 1, "ground_surface": 1, "mic_height_m": 1}
TOLERANCES = {"mic_distance_m": 0.01, "mic_height_m": 0.01, "mic_angle_deg": 2.0}
INSERTION_METRICS = ["Lpeak_Z", "Lpeak_A", "Lpeak_C", "LAE", "LZE", "LAImax"]
SEVERITY_RANK = {"advisory": 0, "material": 1, "blocking": 2}
DRIFT_LIMIT_DB = 0.5
MIN_SHOTS = 5


def text(name: str) -> Column:
    """Trimmed text; blank counts as not recorded."""
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))


def number(name: str) -> Column:
    """Finite number held by a numeric or text column."""
    as_text = F.trim(F.col(name).cast("string"))
    plain = as_text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return L.finite(F.when(plain, as_text.try_cast("double")))


def parse_date(name: str) -> Column:
    """Date in the first of four formats that fits; the shape of the text picks the format."""
    t = text(name)
    return (F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d"))
            .when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(t, "yyyy/M/d"))
            .when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
                  F.coalesce(F.try_to_date(t, "d/M/yyyy"), F.try_to_date(t, "M/d/yyyy"))))


NUMBERS = ["mic_distance_m", "mic_angle_deg", "mic_height_m", "temperature_C", "humidity_pct", "pressure_kPa",
           "calibration_pre_dB", "calibration_post_dB"]
TEXTS = ["configuration", "weapon", "ammunition", "mic_model", "mic_serial", "location", "operator", "windscreen",
         "ground_surface", "date"]


def typed(df: DataFrame, prefixes: tuple[str, ...] = ("ref_", "test_")) -> DataFrame:
    """Numbers as doubles and texts trimmed, parsed once per row; blanks become NULL."""
    kinds = dict(df.dtypes)
    out = {}
    for p in prefixes:
        for c in NUMBERS:
            if p + c in kinds:
                out[p + c] = number(p + c) if kinds[p + c] == "string" else L.finite(p + c)
        for c in TEXTS:
            if p + c in kinds:
                out[p + c] = text(p + c)
    return df.withColumns(out)


def _agree_numbers(field: str) -> Column:
    return F.abs(F.col(f"ref_{field}").cast("double") - F.col(f"test_{field}").cast("double")) <= TOLERANCES[field]


def fields_agree(field: str) -> Column:
    """Numbers within tolerance, otherwise the same value; not recorded never agrees. Takes typed columns."""
    if field in TOLERANCES:
        return F.coalesce(_agree_numbers(field), F.lit(False))
    return F.coalesce(profile_value(f"ref_{field}") == profile_value(f"test_{field}"), F.lit(False))


def match_score() -> Column:
    total = F.lit(0.0)
    for field, weight in SCORE_FIELDS.items():
        total = total + F.when(fields_agree(field), float(weight)).otherwise(0.0)
    return total


def differs(field: str) -> Column:
    return F.coalesce(F.lower(f"ref_{field}") != F.lower(f"test_{field}"), F.lit(False))


def disqualified() -> Column:
    """Why a reference cannot serve a test at all, or NULL."""
    config = F.lower("ref_configuration")
    return (F.when(differs("weapon"), "weapon differs").when(differs("ammunition"), "ammunition differs")
            .when(config != "unsuppressed", "candidate is not unsuppressed"))


def prefixed(df: DataFrame, prefix: str, keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    return df.select(*[F.col(c).alias(c if c in keep else f"{prefix}_{c}") for c in df.columns])


def designated_pairs(recordings: DataFrame, session: str, order: str) -> DataFrame:
    """Every suppressed recording next to its session's first unsuppressed one."""
    config = F.lower(text("configuration"))
    first = (recordings.where(config == "unsuppressed").groupBy(session)
             .agg(F.min_by(F.struct(*recordings.columns), F.col(order)).alias("_r")).select("_r.*"))
    tests = prefixed(recordings.where(config == "suppressed"), "test", [session])
    return tests.join(prefixed(first, "ref", [session]), session)


def _rule(when: Column, code, severity, dB: Column | None = None, correctable: bool = False) -> Column:
    return F.when(when, F.struct(
        (code if isinstance(code, Column) else F.lit(code)).alias("code"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"),
        (F.lit(None) if dB is None else dB).cast("double").alias("quantified_dB"),
        F.lit(correctable).alias("correctable")))


def _both(field: str, get) -> tuple[Column, Column, Column]:
    ref, test = get(f"ref_{field}"), get(f"test_{field}")
    return ref, test, ref.isNull() | test.isNull()


def with_air(pairs: DataFrame) -> DataFrame:
    """Typed pairs with the absorption difference per metre at 1 and 4 kHz, and the days between."""
    out = typed(pairs)
    out = out.withColumns({f"_air_{side}": air.terms(
        F.col(f"{side}_temperature_C"), F.col(f"{side}_humidity_pct"),
        F.coalesce(F.col(f"{side}_pressure_kPa"), F.lit(air.P_REF_KPA))) for side in ("ref", "test")})
    change = {f"_air_{hz:.0f}": air.alpha(F.lit(hz), F.col("_air_test")) - air.alpha(F.lit(hz), F.col("_air_ref"))
              for hz in (1000.0, 4000.0)}
    gap = F.abs(F.datediff(parse_date("test_date"), parse_date("ref_date")))
    return out.withColumns({**change, "_gap": gap})


def objection_rules(columns: list[str]) -> list[Column]:
    """Reasons a pair is not a clean comparison, as nullable structs."""
    ref_c, test_c, no_config = _both("configuration", F.lower)
    same = ~no_config & (ref_c == test_c)
    rules = [
        _rule(no_config, "configuration_missing", "advisory"),
        _rule(same, "configuration_identical", "blocking"),
        _rule(~no_config & ~same & (ref_c != "unsuppressed"), "reference_not_unsuppressed", "blocking"),
    ]
    for field in ("weapon", "ammunition"):
        _, _, missing = _both(field, F.col)
        rules += [_rule(missing, f"{field}_missing", "advisory"), _rule(differs(field), f"{field}_differs", "blocking")]

    ref_d, test_d, no_d = _both("mic_distance_m", F.col)
    bad = ~no_d & ((ref_d <= 0) | (test_d <= 0))
    rules += [
        _rule(no_d, "distance_missing", "material"), _rule(bad, "distance_invalid", "blocking"),
        _rule(~no_d & ~bad & (F.abs(ref_d - test_d) > TOLERANCES["mic_distance_m"]), "distance_differs", "material",
              air.spreading(test_d, ref_d), True)]
    ref_a, test_a, no_a = _both("mic_angle_deg", F.col)
    rules += [_rule(no_a, "angle_missing", "material"),
              _rule(F.abs(ref_a - test_a) > TOLERANCES["mic_angle_deg"], "angle_differs", "blocking")]
    ref_h, test_h, _ = _both("mic_height_m", F.col)
    rules += [_rule(F.abs(ref_h - test_h) > TOLERANCES["mic_height_m"], "height_differs", "material"),
              _rule(differs("ground_surface"), "ground_differs", "material")]

    ref_t, test_t, no_t = _both("temperature_C", F.col)
    ref_rh, test_rh, no_rh = _both("humidity_pct", F.col)
    weather = ~(no_t | no_rh) & ((F.abs(ref_t - test_t) > 5.0) | (F.abs(ref_rh - test_rh) > 20.0))
    path = F.coalesce(F.nullif(test_d, F.lit(0.0)), ref_d)
    usable = F.coalesce(path > 0, F.lit(False))
    low, high = F.col("_air_1000") * path, F.col("_air_4000") * path
    worst = F.when(F.abs(high) > F.abs(low), high).otherwise(low)
    rules += [_rule(no_t | no_rh, "weather_missing", "advisory"),
              _rule(weather & ~usable, "weather_differs", "advisory"),
              _rule(weather & usable, "weather_differs", "material", worst, True),
              _rule(differs("mic_model"), "mic_model_differs", "material"),
              _rule(F.col("ref_mic_serial") != F.col("test_mic_serial"), "mic_serial_differs", "advisory")]
    for side, label in (("ref", "reference"), ("test", "test")):
        drift = F.col(f"{side}_calibration_post_dB") - F.col(f"{side}_calibration_pre_dB")
        rules.append(_rule(F.abs(drift) > DRIFT_LIMIT_DB, f"{label}_calibration_drift", "material", drift))
    gap = F.col("_gap")
    rules += [_rule(differs("windscreen"), "windscreen_differs", "material"),
              _rule(gap > 0, "different_day", F.when(gap <= 1, "advisory").otherwise("material")),
              _rule(differs("location"), "location_differs", "blocking")]
    for side, label in (("ref", "reference"), ("test", "test")):
        if f"{side}_n_valid" in columns:
            n = F.col(f"{side}_n_valid")
            rules += [_rule(n == 0, f"{label}_empty", "blocking"),
                      _rule((n > 0) & (n < MIN_SHOTS), f"{label}_short", "material")]
    if "ref_n_bands" in columns and "test_n_bands" in columns:
        a, b = F.col("ref_n_bands"), F.col("test_n_bands")
        rules.append(_rule((a > 0) & (b > 0) & (a != b), "band_layout_differs", "blocking"))
    return rules


def severity_rank(name: str = "severity") -> Column:
    return F.when(F.col(name) == "blocking", 2).when(F.col(name) == "material", 1).otherwise(0)


def objections(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per objection of every pair."""
    found = F.array_compact(F.array(*objection_rules(pairs.columns)))
    return with_air(pairs).select(*keys, F.inline(found)).withColumn("rank", severity_rank())


def comparability(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pair; its rules are folded inside the row, without a shuffle."""
    found = F.array_compact(F.array(*objection_rules(pairs.columns)))
    o = with_air(pairs).select(*keys, found.alias("_o"))
    priced = F.filter("_o", lambda x: x["quantified_dB"].isNotNull())
    return o.select(
        *keys, F.size("_o").alias("n_objections"),
        (~F.exists("_o", lambda x: x["severity"] == "blocking")).alias("comparable"),
        F.aggregate(priced, F.lit(0.0), lambda a, x: a + F.abs(x["quantified_dB"])).alias("unexplained_dB"),
        ((F.size(priced) > 0) & F.forall(priced, lambda x: x["correctable"])).alias("all_correctable"),
    )


PROFILE = [*SCORE_FIELDS, "weapon", "ammunition"]


def profile_value(field: str, kind: str = "string") -> Column:
    """One spelling for values that agree: numbers as numbers, text in lower case."""
    if kind != "string":
        return L.finite(field).cast("string")
    return F.coalesce(number(field).cast("string"), F.lower(text(field)))


def _spelled(recordings: DataFrame, session: str) -> DataFrame:
    """Recordings reduced to what pairing looks at, spelled once."""
    kinds = dict(recordings.dtypes)
    return recordings.select(session, "recording_id", F.lower(text("configuration")).alias("_config"),
                             *[profile_value(c, kinds[c]).alias(f"_k_{c}") for c in PROFILE])


def _profiles(spelled: DataFrame, session: str, prefix: str) -> DataFrame:
    """Distinct set-ups of a session with how many recordings share them."""
    return spelled.select(session, "recording_id", *[F.col(f"_k_{c}").alias(f"{prefix}_{c}") for c in PROFILE]).groupBy(
        session, *[f"{prefix}_{c}" for c in PROFILE]).agg(
        F.count("*").alias(f"{prefix}_count"), F.min("recording_id").alias(f"{prefix}_id"))


def _score_of_profiles() -> Column:
    """match_score on set-ups, whose values are already spelled alike."""
    total = F.lit(0.0)
    for c, weight in SCORE_FIELDS.items():
        same = _agree_numbers(c) if c in TOLERANCES else F.col(f"ref_{c}") == F.col(f"test_{c}")
        total = total + F.when(same, float(weight)).otherwise(0.0)
    return total


def _best_by_join(tests: DataFrame, refs: DataFrame, session: str) -> DataFrame:
    """Best score of every test by comparing it with its session's reference set-ups.

    Everything groups by session first, as the join does, so the join's
    shuffle serves the grouping too.
    """
    pairs = tests.join(refs, session).where(~differs("weapon") & ~differs("ammunition"))
    key = [session, "recording_id"]
    return _top_score(pairs.select(*key, _score_of_profiles().alias("w"), F.col("ref_count").alias("n"),
                                   F.col("ref_id").alias("id")), key)


def _top_score(hits: DataFrame, key: list[str]) -> DataFrame:
    """Best weight of each test set-up, how many references reach it, and the first of them."""
    by_weight = hits.groupBy(*key, "w").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    return by_weight.groupBy(*key).agg(F.max(F.struct("w", "n", "id")).alias("b")).select(
        *key, F.col("b.w").alias("score"), F.col("b.n").alias("n_best"), F.col("b.id").alias("best_id"))


def _best_by_subsets(tests: DataFrame, refs: DataFrame, session: str) -> DataFrame:
    """The same answer for sessions with too many set-ups to compare each with each.

    A reference that agrees with a test on a set S of fields is found under the
    key (S, values of S). Every reference set-up is counted once under each of
    its subsets; a test looks its own subsets up, best weight first. Rows grow
    linearly with the set-ups. The numeric fields are matched through the
    session's distinct values, so tolerances stay exact.
    """
    fields = list(SCORE_FIELDS)
    near = tests
    for c in TOLERANCES:
        a = tests.select(session, f"test_{c}").distinct().where(F.col(f"test_{c}").isNotNull())
        b = refs.select(session, f"ref_{c}").distinct().where(F.col(f"ref_{c}").isNotNull())
        width = max(TOLERANCES[c], 1e-9)
        cell_b = b.withColumn("_c", F.explode(F.array(*[
            F.floor(F.col(f"ref_{c}").cast("double") / width) + d for d in (-1, 0, 1)])))
        cell_a = a.withColumn("_c", F.floor(F.col(f"test_{c}").cast("double") / width))
        match = (cell_a.join(cell_b, [session, "_c"]).where(_agree_numbers(c))
                 .groupBy(session, f"test_{c}").agg(F.collect_set(f"ref_{c}").alias(f"_near_{c}")))
        near = near.join(match, [session, f"test_{c}"], "left")

    def subsets(rows: DataFrame, value_of) -> DataFrame:
        """Rows times the subsets of their fields, built field by field: weight and key text."""
        out = rows.withColumn("w", F.lit(0.0)).withColumn("k", F.lit(""))
        for i, c in enumerate(fields):
            out = out.withColumn("_o", F.explode(F.concat(F.array(F.lit(None).cast("string")), value_of(c))))
            taken = F.col("_o").isNotNull()
            out = out.withColumn("w", F.col("w") + F.when(taken, float(SCORE_FIELDS[c])).otherwise(0.0))
            out = out.withColumn("k", F.when(taken, F.concat("k", F.lit(f"|{i}="), "_o")).otherwise(F.col("k"))).drop("_o")
        return out

    def ref_value(c):
        return F.array_compact(F.array(F.col(f"ref_{c}")))

    def test_value(c):
        if c in TOLERANCES:
            return F.coalesce(F.col(f"_near_{c}"), F.array().cast("array<string>"))
        return F.array_compact(F.array(F.col(f"test_{c}")))

    gates = ("weapon", "ammunition")
    none = F.lit("\0none")
    ref_rows = subsets(refs, ref_value).select(session, "ref_count", "ref_id", "w", "k", *[
        F.coalesce(F.col(f"ref_{g}"), none).alias(f"_{g}") for g in gates])
    index = ref_rows.groupBy(session, "_weapon", "_ammunition", "k").agg(
        F.sum("ref_count").alias("n"), F.min("ref_id").alias("id"))
    # A test that does not name its weapon meets every weapon of the session.
    seen = refs.select(session, *[F.coalesce(F.col(f"ref_{g}"), none).alias(f"_{g}") for g in gates]).distinct()
    key = [session, *[f"test_{c}" for c in PROFILE]]
    probes = subsets(near, test_value).select(*key, "w", "k").join(seen, session)
    for g in gates:
        probes = probes.where(F.col(f"test_{g}").isNull() | (F.col(f"_{g}") == F.col(f"test_{g}")) | (F.col(f"_{g}") == none))
    hits = probes.join(index, [session, "_weapon", "_ammunition", "k"])
    return _top_score(hits, key)


def auto_pair(recordings: DataFrame, session: str, pair_limit: int = 250_000) -> DataFrame:
    """The unique best reference of every suppressed recording, or a refusal.

    References are first reduced to distinct set-ups per session. A session's
    tests are compared with them while that is at most `pair_limit`
    comparisons; beyond it the subset index gives the same answer.
    """
    spelled = checkpointed(_spelled(recordings, session))
    tests = spelled.where("_config = 'suppressed'").select(
        session, "recording_id", *[F.col(f"_k_{c}").alias(f"test_{c}") for c in PROFILE])
    refs = _profiles(spelled.where("_config = 'unsuppressed'"), session, "ref")
    sizes = (tests.groupBy(session).agg(F.count("*").alias("_t"))
             .join(refs.groupBy(session).agg(F.count("*").alias("_r")), session))
    wide = sizes.where(F.col("_t").cast("double") * F.col("_r") > pair_limit).select(session)
    if wide.limit(1).count():
        best = _best_by_join(tests.join(wide, session, "left_anti"), refs.join(wide, session, "left_anti"), session)
        many = tests.join(wide, session, "left_semi")
        setups = _profiles(spelled.where("_config = 'suppressed'").join(wide, session, "left_semi"), session, "test")
        found = _best_by_subsets(setups, refs.join(wide, session, "left_semi"), session)
        same = many[session] == found[session]
        for c in PROFILE:
            same = same & many[f"test_{c}"].eqNullSafe(found[f"test_{c}"])
        best = best.unionByName(many.join(found, same).select(many[session], "recording_id", "score", "n_best", "best_id"))
    else:
        best = _best_by_join(tests, refs, session)
    n_refs = refs.groupBy(session).agg(F.sum("ref_count").alias("_n_refs"))
    out = tests.select(session, "recording_id").join(best, [session, "recording_id"], "left").join(n_refs, session, "left")
    refusal = (F.when(F.col("_n_refs").isNull(), "no unsuppressed recording in the session")
               .when(F.col("score").isNull(), "every reference is disqualified")
               .when(F.col("n_best") > 1, F.concat(F.col("n_best").cast("string"), F.lit(" references match equally well"))))
    return out.select(session, "recording_id", F.when(refusal.isNull(), F.col("best_id")).alias("reference_id"),
                      "score", "n_best", refusal.alias("refusal"))


def insertion_loss(ref: DataFrame, test: DataFrame, on: list[str]) -> DataFrame:
    """Reference minus test of metric statistics, with the combined interval."""
    a = ref.select(*on, "metric", F.col("mean").alias("reference_dB"), F.col("n").alias("reference_n"),
                   F.col("ci95").alias("_a"))
    b = test.select(*on, "metric", F.col("mean").alias("test_dB"), F.col("n").alias("test_n"), F.col("ci95").alias("_b"))
    loss = F.col("reference_dB") - F.col("test_dB")
    ci = F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b"))
    return (a.join(b, [*on, "metric"]).where(F.col("reference_dB").isNotNull() & F.col("test_dB").isNotNull())
            .withColumn("reduction_dB", loss).withColumn("ci95_dB", ci)
            .withColumn("significant", F.abs(loss) > ci).drop("_a", "_b"))


def band_insertion_loss(stats: DataFrame, on: list[str], complete: bool = True) -> DataFrame:
    """Per-band reference minus test of band statistics held in one table.

    `stats` has a configuration column. With `complete`, only keys whose two
    sets of bands are the same are compared.
    """
    is_ref, is_test = F.col("configuration") == "unsuppressed", F.col("configuration") == "suppressed"
    g = stats.groupBy(*on, "band").agg(*[
        F.max(F.when(side, F.col(c))).alias(f"{p}_{c}") for side, p in ((is_ref, "ref"), (is_test, "test"))
        for c in ("mean", "se", "n")])
    both = F.col("ref_mean").isNotNull() & F.col("test_mean").isNotNull()
    if complete:
        same = g.groupBy(*on).agg(F.bool_and(both).alias("_same")).where("_same").select(*on)
        g = g.join(same, on, "left_semi")
    loss = F.col("ref_mean") - F.col("test_mean")
    ci = 1.96 * F.sqrt(F.col("ref_se") * F.col("ref_se") + F.col("test_se") * F.col("test_se"))
    return g.where(both).select(
        *on, "band", F.col("ref_mean").alias("reference_dB"), F.col("test_mean").alias("test_dB"),
        loss.alias("loss_dB"), ci.alias("ci95_dB"),
        F.when(F.abs(loss) <= ci, "inconclusive").when(loss < 0, "increase").otherwise("reduction").alias("finding"))


def comparison_guards(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Refusals and warnings before a stored reference is differenced."""
    c = F.col
    refusal = (F.when(~c("ref_level_unit").eqNullSafe(c("test_level_unit")), "level units differ")
               .when(c("ref_n_valid") == 0, "reference has no valid shots"))
    warnings = F.array_compact(F.array(
        F.when(~c("ref_Pa_per_FS").eqNullSafe(c("test_Pa_per_FS")), "calibration factors differ"),
        F.when(~c("ref_fs").eqNullSafe(c("test_fs")), "sample rates differ"),
        F.when(~F.coalesce(c("ref_calibrated"), F.lit(False)), "reference is uncalibrated")))
    return pairs.select(*keys, refusal.alias("refusal"), F.when(refusal.isNull(), warnings).alias("warnings"))


def session_rollup(recordings: DataFrame, pairs: DataFrame, session: str) -> DataFrame:
    """Analysed and failed counts, unconfigured recordings, paired and refused tests."""
    failed = F.col("error").isNotNull()
    config = F.lower(text("configuration"))
    known = F.coalesce(config.isin("suppressed", "unsuppressed"), F.lit(False))
    g = recordings.groupBy(session).agg(
        F.count_if(~failed).alias("n_analysed"), F.count_if(failed).alias("n_failed"),
        F.count_if(~failed & ~known).alias("n_unconfigured"),
        F.count_if(~failed & (config == "unsuppressed")).alias("n_references"))
    p = pairs.groupBy(session).agg(F.count_if(F.col("refusal").isNull()).alias("n_paired"),
                                   F.count_if(F.col("refusal").isNotNull()).alias("n_refused"))
    return g.join(p, session, "left").na.fill(0, ["n_paired", "n_refused"])


def baseline_drift(levels: DataFrame, session: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Trend of the unsuppressed strings' energy means (`level`) over their order."""
    at = numbered(levels, [session], order, "_at", limit)
    x = F.col("_at").cast("double")
    g = at.groupBy(session).agg(
        F.count("*").alias("n_baselines"), F.regr_slope("level", x).alias("_slope"),
        F.min_by("level", "_at").alias("_first"), F.max_by("level", "_at").alias("_last"))
    n = F.col("n_baselines")
    return g.select(session, "n_baselines", F.when(n >= 3, F.col("_slope")).alias("trend_dB_per_string"),
                    F.when(n == 2, F.col("_last") - F.col("_first")).alias("moved_dB"))


def session_pop(shots: DataFrame, session: list[str], string: list[str], order: list[str],
                level: str = "level") -> DataFrame:
    """First-round pop across the suppressed strings of each session."""
    used = shots.where((F.lower(F.col("configuration")) == "suppressed") & F.col("valid"))
    return first_round_pop_across(used, string, session, order, level)


def propose_pair(runs: DataFrame, group: list[str], fields: list[str], time: str) -> DataFrame:
    """Newest suppressed run and the unsuppressed run sharing most fields with it.

    One test per group, so each reference is scored once. Ties go to the newest.
    """
    newest = runs.where("configuration = 'suppressed'").groupBy(*group).agg(
        F.max_by(F.struct("recording_id", *fields), F.struct(F.col(time), F.col("recording_id"))).alias("_t"))
    refs = runs.where("configuration = 'unsuppressed'").join(newest, group)
    score = F.lit(0)
    for f in fields:
        score = score + F.coalesce((text(f) == F.trim(F.col(f"_t.{f}").cast("string"))).cast("int"), F.lit(0))
    return refs.withColumn("_s", score).groupBy(*group).agg(
        F.any_value("_t.recording_id").alias("test_id"),
        F.max_by(F.struct(F.col("recording_id").alias("reference_id"), F.col("_s").alias("shared")),
                 F.struct("_s", F.col(time), F.col("recording_id"))).alias("_b")).select(*group, "test_id", "_b.*")
