"""Scores, comparisons of runs, subgroup audits and bootstrap errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import columns as C
from ..functions.wording import AGE_BANDS, BLEND_WEIGHTS, COARSE_AGE, COARSE_AGE_BANDS
from ..operators import ensemble, fairness, metrics, resample, responses
from ..plans import studies
from .registry import query
from .views import Views


@query(
    "attach_predictions",
    "v_events v_responses",
    """select e.row_id, e.clicked::bigint clicked, policy, round(case policy when 'hard0' then prob else coalesce(prob, 0.5e0) end, 6) prob,
       case policy when 'hard0' then coalesce(hard, 0) else (coalesce(prob, 0.5e0) >= 0.5e0)::bigint end::bigint as hard
       from v_events e left join (select row_id, exp(logprob) prob, (text = '1')::int hard from v_responses where text is not null) r on e.row_id = r.row_id,
       (select unnest(['hard0', 'prob_half']) policy)""",
)
def attach_predictions(v: Views):
    rows = v.events().select("row_id", "clicked")
    answered = v.responses().filter(F.col("text").isNotNull())
    preds = answered.select("row_id", F.exp("logprob").alias("prob"), (F.col("text") == "1").cast("int").alias("hard"))
    parts = [
        responses.attach_predictions(rows, preds, policy).withColumn("policy", F.lit(policy)) for policy in ("hard0", "prob_half")
    ]
    return parts[0].unionByName(parts[1])


def two_runs(v: Views):
    wide = v.predictions()
    return (wide.select("row_id", "y", F.col(f"h_{s}").alias("hard")) for s in ("a", "b"))


@query("pair_runs", "v_predictions", "select row_id, h_a::bigint hard_a, h_b::bigint hard_b from v_predictions")
def pair_runs(v: Views):
    return responses.pair_runs(*two_runs(v))


@query(
    "agreement",
    "v_predictions",
    "select round(avg((h_a = h_b)::int), 6) share, count(*) filter (h_a <> h_b) changed, count(*) n from v_predictions",
)
def agreement(v: Views):
    return metrics.agreement(*two_runs(v))


def cells_sql(source: str, by: str, y: str = "y", hard: str = "hard") -> str:
    """Outcome cells and the scores that follow from them."""
    return f"""(select *, tp + tn + fp + fn n, (tp + tn) / (tp + tn + fp + fn) acc,
        case when tp + fp + fn = 0 then 0e0 else 2 * tp / (2 * tp + fp + fn) end f1_pos,
        list_avg(list_filter([case when tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) end,
          case when tn + fp + fn > 0 then 2 * tn / (2 * tn + fp + fn) end], lambda x: x is not null)) f1_macro,
        list_avg(list_filter([case when tp + fn > 0 then tp / (tp + fn) end,
          case when tn + fp > 0 then tn / (tn + fp) end], lambda x: x is not null)) bal_acc
        from (select {by}, count(*) filter ({y} = 1 and {hard} = 1) tp, count(*) filter ({y} = 0 and {hard} = 1) fp,
        count(*) filter ({y} = 1 and {hard} = 0) fn, count(*) filter ({y} = 0 and {hard} = 0) tn from {source} group by all))"""


def r4(expression: str) -> str:
    return f"round(round_even(({expression}) * 1e4, 0) / 1e4, 6)"


@query(
    "classification_report",
    "v_scored",
    f"select scorer, {r4('acc')} acc, {r4('f1_macro')} f1_macro, {r4('f1_pos')} f1_pos from {cells_sql('v_scored', 'scorer')}",
)
def classification_report(v: Views):
    return metrics.classification_report(v.scored(), by=["scorer"])


@query(
    "balanced_accuracy", "v_scored", f"select scorer, round(bal_acc, 6) bal_acc from {cells_sql('v_scored', 'scorer')}"
)
def balanced_accuracy(v: Views):
    return metrics.balanced_accuracy(v.scored(), by=["scorer"])


RANKED_SQL = """(select *, sum(pos) over (partition by scorer order by prob desc) cp, sum(neg) over (partition by scorer order by prob desc) cn,
    sum(pos) over (partition by scorer) p_all, sum(neg) over (partition by scorer) n_all
    from (select scorer, prob, count(*) filter (y = 1) pos, count(*) filter (y = 0) neg from v_scored group by all))"""
AUC_SQL = "sum(neg * ((cp - pos) + pos / 2)) / max(p_all * n_all)"
AP_SQL = "sum((pos / p_all) * (cp / (cp + cn)))"


@query("roc_auc", "v_scored", f"select scorer, round({AUC_SQL}, 6) auc from {RANKED_SQL} group by scorer")
def roc_auc(v: Views):
    return metrics.roc_auc(v.scored(), by=["scorer"])


@query("average_precision", "v_scored", f"select scorer, round({AP_SQL}, 6) ap from {RANKED_SQL} group by scorer")
def average_precision(v: Views):
    return metrics.average_precision(v.scored(), by=["scorer"])


@query(
    "discrimination_table",
    "v_scored",
    f"""select scorer, round({AUC_SQL}, 6) auc, round({AP_SQL}, 6) ap,
       (select round(avg((y = hard)::int), 6) from v_scored s where s.scorer = r.scorer) acc from {RANKED_SQL} r group by scorer""",
)
def discrimination_table(v: Views):
    return metrics.discrimination_table(v.scored())


@query(
    "threshold_pred",
    "v_predictions",
    "select row_id, (p_a >= 0.5e0)::bigint hard, (p_b >= 0.3e0)::bigint low from v_predictions",
)
def threshold_pred(v: Views):
    return v.predictions().select(
        "row_id", C.threshold(F.col("p_a")).alias("hard"), C.threshold(F.col("p_b"), 0.3).alias("low")
    )


@query(
    "correction_effect",
    "v_predictions",
    f"""select {r4('a.acc')} acc_before, {r4('a.f1_macro')} f1_before, {r4('b.acc')} acc_after, {r4('b.f1_macro')} f1_after,
       (select count(*) filter (h_a <> h_b) from v_predictions) changed, a.n::bigint n
       from {cells_sql('v_predictions', '1 k', hard='h_a')} a, {cells_sql('v_predictions', '1 k', hard='h_b')} b""",
)
def correction_effect(v: Views):
    return metrics.correction_effect(*two_runs(v))


@query(
    "iteration_trajectory",
    "v_iterations",
    f""", s as (select iteration, round_even(acc * 1e4, 0) / 1e4 acc, f1_macro, f1_pos from {cells_sql('v_iterations', 'iteration')})
       select iteration, round(acc, 6) acc, {r4('f1_macro')} f1_macro, {r4('f1_pos')} f1_pos,
       {r4('(select arg_max(acc, iteration) - arg_min(acc, iteration) from s)')} lift from s""",
)
def iteration_trajectory(v: Views):
    return metrics.iteration_trajectory(v.iterations())


# ------------------------------------------------------------------------- subgroups

LEVELS = {"u_age": AGE_BANDS, "coarse": COARSE_AGE_BANDS}
DIMS = ("u_gender", "u_age", "coarse")


def audited(v: Views):
    return v.predictions().select(
        "row_id",
        "y",
        F.col("p_a").alias("prob"),
        F.col("h_a").alias("hard"),
        "u_gender",
        "u_age",
        C.recode(F.col("u_age"), COARSE_AGE).alias("coarse"),
    )


AUDIT_SQL = f"""aud as (select row_id, y, p_a prob, h_a hard, coalesce(u_gender, 'nan') u_gender, u_age,
      case when u_age in ('12-17', '18-23') then '<24' when u_age in ('24-30', '31-40') then '24-40'
      when u_age in ('41-49', '50+') then '40+' else u_age end coarse from v_predictions),
    long as (select y, prob, hard, 'u_gender' dim, u_gender as "group" from aud union all select y, prob, hard, 'u_age', u_age from aud
      union all select y, prob, hard, 'coarse', coarse from aud),
    listed(dim, "group") as (values {', '.join(f"('{d}', '{g}')" for d, gs in LEVELS.items() for g in gs)}),
    groups as (select * from listed union select dim, "group" from long where dim = 'u_gender'),
    target as (select 1e0 - (1e0 - count(*) filter (y = 1 and prob < 0.5e0) / greatest(count(*) filter (y = 1), 1)) q from aud)"""


def rates_sql(hard: str = "hard") -> str:
    hits = {
        "tp": f"count(*) filter (y = 1 and {hard} = 1)",
        "fp": f"count(*) filter (y = 0 and {hard} = 1)",
        "fn": f"count(*) filter (y = 1 and {hard} = 0)",
        "tn": f"count(*) filter (y = 0 and {hard} = 0)",
    }
    return f"""count(y) n, case when count(y) > 0 then ({hits['tp']} + {hits['tn']}) / count(y) end acc,
        case when count(y) > 0 then {hits['fp']} / greatest({hits['fp']} + {hits['tn']}, 1) end fpr,
        case when count(y) > 0 then {hits['fn']} / greatest({hits['fn']} + {hits['tp']}, 1) end fnr"""


GROUP_RATES_SQL = f"""rates as (select g.dim, g."group", {rates_sql()} from groups g left join long l on g.dim = l.dim and g."group" = l."group" group by all
    union all select 'overall', null, {rates_sql()} from aud)"""


@query(
    "group_rates",
    "v_predictions",
    f', {AUDIT_SQL}, {GROUP_RATES_SQL} select dim, "group", n, round(acc, 6) acc, round(fpr, 6) fpr, round(fnr, 6) fnr from rates',
)
def group_rates(v: Views):
    return fairness.group_rates(audited(v), DIMS, levels=LEVELS)


@query(
    "group_rates_documents",
    "",
    """with d as (select lang, source, quality y, 1 - toxic hard from documents join labels using (doc_id)),
       long as (select y, hard, 'lang' dim, lang as "group" from d union all select y, hard, 'source', source from d union all select y, hard, 'overall', null from d)
       select dim, "group", n, round(acc, 6) acc, round(fpr, 6) fpr, round(fnr, 6) fnr from (select dim, "group", """
    + rates_sql()
    + ' from long group by dim, "group")',
)
def group_rates_documents(v: Views):
    labelled = v.table("documents").select("doc_id", "lang", "source").join(v.table("labels"), "doc_id")
    scored = labelled.select("lang", "source", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("hard"))
    return fairness.group_rates(scored, ["lang", "source"])


@query(
    "rate_spread",
    "v_predictions",
    f""", {AUDIT_SQL}, {GROUP_RATES_SQL} select dim, round(max(fpr) - min(fpr), 6) fpr_spread, round(max(fnr) - min(fnr), 6) fnr_spread
       from rates where "group" is not null and n > 0 group by dim""",
)
def rate_spread(v: Views):
    return fairness.rate_spread(fairness.group_rates(audited(v), DIMS, levels=LEVELS))


# quantile_cont wants a constant share, so the quantile is interpolated by position
TAU_SQL = """ranked as (select dim, "group", prob, row_number() over (partition by dim, "group" order by prob) - 1 i,
      q * (count(*) over (partition by dim, "group") - 1) h from long, target where y = 1),
    found as (select dim, "group", max(prob) filter (i = floor(h)) lo, max(prob) filter (i = ceil(h)) hi, max(h - floor(h)) t from ranked group by all),
    taus as (select g.dim, g."group", coalesce(lo + (hi - lo) * t, 0.5e0) tau from groups g left join found f on g.dim = f.dim and g."group" = f."group")"""


@query("equal_opportunity", "v_predictions", f', {AUDIT_SQL}, {TAU_SQL} select dim, "group", round(tau, 6) tau from taus')
def equal_opportunity(v: Views):
    return fairness.equal_opportunity(audited(v), DIMS, levels=LEVELS)


@query(
    "recalibrated_audit",
    "v_predictions",
    f""", {AUDIT_SQL}, {TAU_SQL},
    moved as (select l.*, case when prob >= coalesce(tau, 0.5e0) then 1 else 0 end moved, tau from long l left join taus t on l.dim = t.dim and l."group" = t."group"),
    stages as (select 'before' stage, dim, "group", y, hard as decided from moved union all select 'after', dim, "group", y, moved from moved),
    groups2 as (select stage, dim, "group" from groups, (select unnest(['before', 'after']) stage)),
    rates as (select g.stage, g.dim, g."group", {rates_sql('decided')} from groups2 g left join stages s
        on g.stage = s.stage and g.dim = s.dim and g."group" = s."group" group by all
      union all select stage, dim, null, {rates_sql('decided')} from stages group by stage, dim),
    spread as (select stage, dim, max(fpr) - min(fpr) fpr_spread, max(fnr) - min(fnr) fnr_spread from rates where "group" is not null and n > 0 group by all)
    select r.stage, r.dim, r."group", n, round(acc, 6) acc, round(fpr, 6) fpr, round(fnr, 6) fnr,
    round(case when r.stage = 'after' and n > 0 then tau end, 6) tau, round(fpr_spread, 6) fpr_spread, round(fnr_spread, 6) fnr_spread
    from rates r join spread s on r.stage = s.stage and r.dim = s.dim left join taus t on r.dim = t.dim and r."group" = t."group" """,
)
def recalibrated_audit(v: Views):
    return fairness.recalibrated_audit(audited(v), DIMS, levels=LEVELS)


# --------------------------------------------------------------------- blends, errors

WEIGHTS_SQL = ", ".join(f"{w}e0" for w in BLEND_WEIGHTS)


@query(
    "blend_grid",
    "v_predictions",
    f""", mixed as (select w, y, case when w * p_a + (1e0 - w) * p_b >= 0.5e0 then 1 else 0 end hard
         from v_predictions, (select unnest([{WEIGHTS_SQL}]) w)),
       scores as (select w, round_even(acc * 1e4, 0) / 1e4 acc, round_even(f1_macro * 1e4, 0) / 1e4 f1 from {cells_sql('mixed', 'w')})
       select round(w, 6) w, round(acc, 6) acc, round(f1, 6) f1,
       (w = (select w from scores order by acc desc, w limit 1))::bigint best from scores""",
)
def blend_grid(v: Views):
    return ensemble.blend_grid(v.predictions(), "p_a", "p_b")


@query(
    "error_overlap",
    "v_predictions",
    """select round(avg(e1), 6) wrong_1, round(avg(e2), 6) wrong_2, round(avg(e1 * e2), 6) both_wrong, round(corr(e1, e2), 6) error_corr
       from (select (h_a <> y)::int::double e1, (h_b <> y)::int::double e2 from v_predictions)""",
)
def error_overlap(v: Views):
    return ensemble.error_overlap(v.predictions(), "h_a", "h_b")


@query(
    "bootstrap_prediction",
    "v_predictions",
    """select scorer, 'acc' metric, round(acc, 6) true_value, 1::bigint mean_near, 1::bigint sd_near from (
         select 'h_a' scorer, avg((h_a = y)::int) acc from v_predictions union all select 'h_b', avg((h_b = y)::int) from v_predictions)
       union all select scorer, 'f1_macro', round((2e0 * tp / (2 * tp + fp + fn) + 2e0 * tn / (2 * tn + fp + fn)) / 2, 6), 1, 1 from (
         select scorer, count(*) filter (h = 1 and y = 1) tp, count(*) filter (h = 0 and y = 0) tn,
           count(*) filter (h = 1 and y = 0) fp, count(*) filter (h = 0 and y = 1) fn
         from (select 'h_a' scorer, h_a h, y from v_predictions union all select 'h_b', h_b, y from v_predictions) group by scorer)""",
)
def bootstrap_prediction(v: Views):
    """Bootstrap means beside the true values; the deviation of accuracy beside sqrt(p (1 - p) / n)."""
    rows = v.predictions()
    drawn = resample.bootstrap_scores(rows, ["h_a", "h_b"], DEFAULTS.bootstrap_draws, DEFAULTS.seed)
    parts = []
    for scorer in ("h_a", "h_b"):
        scored = rows.select(F.col(scorer).alias("hard"), "y")
        cells = metrics.confusion(scored, "y")
        n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
        report = cells.select(metrics.accuracy().alias("acc"), metrics.f1_macro().alias("f1_macro"), n.alias("n"))
        parts.append(report.unpivot("n", ["acc", "f1_macro"], "metric", "true_value").withColumn("scorer", F.lit(scorer)))
    p, draws = F.col("true_value"), DEFAULTS.bootstrap_draws
    expected = F.sqrt(p * (1 - p) / F.col("n"))
    # macro-F1 of a resample is not unbiased: its mean may be off by a tenth of a deviation
    slack = F.when(F.col("metric") == "acc", 6 * expected / F.sqrt(F.lit(draws))).otherwise(0.2 * F.col("sd"))
    sd_near = F.when(F.col("metric") == "acc", F.abs(F.col("sd") - expected) <= 6 * expected / F.sqrt(F.lit(2 * draws)))
    return drawn.join(parts[0].unionByName(parts[1]), ["scorer", "metric"]).select(
        "scorer",
        "metric",
        "true_value",
        (F.abs(F.col("mean") - p) <= slack).cast("int").alias("mean_near"),
        sd_near.otherwise(F.col("sd") > 0).cast("int").alias("sd_near"),
    )


# ------------------------------------------------------------------------- studies

SCORES_SQL = """mixed as (select w, y, case when w * p_a + (1e0 - w) * p_b >= 0.5e0 then 1 else 0 end hard
         from v_predictions, (select unnest([{weights}]) w)),
       grid as (select w, round_even(acc * 1e4, 0) / 1e4 acc, round_even(f1_macro * 1e4, 0) / 1e4 f1 from {cells})"""


@query(
    "ensemble_study",
    "v_predictions",
    f""", {SCORES_SQL.format(weights=WEIGHTS_SQL, cells=cells_sql('mixed', 'w'))},
       alone as (select 'a' name, y, (p_a >= 0.5e0)::int hard from v_predictions union all select 'b', y, (p_b >= 0.5e0)::int from v_predictions)
       select name, null::double w, {r4('acc')} acc, {r4('f1_macro')} f1_macro from {cells_sql('alone', 'name')}
       union all select 'best blend', round(w, 6), round(acc, 6), round(f1, 6) from (select * from grid order by acc desc, w limit 1)""",
)
def ensemble_study(v: Views):
    return studies.ensemble_study(v.predictions(), {"a": "p_a", "b": "p_b"}, "a", "b")["record"]


@query(
    "correction_study",
    "v_predictions",
    """select was_right, is_right, count(row_id) n from (values (0::bigint, 0::bigint), (0, 1), (1, 0), (1, 1)) t(was_right, is_right)
       left join (select row_id, (h_a = y)::bigint was_right, (h_b = y)::bigint is_right from v_predictions) using (was_right, is_right) group by all""",
)
def correction_study(v: Views):
    return studies.correction_study(*two_runs(v))["turned"]


@query(
    "progression_study",
    "v_iterations",
    f""", texts as (select iteration, 'Step ' || iteration || chr(10) || 'says yes ' || sum(hard) || ' times   of ' || count(*) as text from v_iterations group by iteration)
       select iteration, 'Iteration ' || iteration || case when iteration = 0 then ' (initial explanation)'
           when iteration = (select max(iteration) from v_iterations) then ' (refined explanation)'
           else ' (after ' || iteration || ' reflection step' || case when iteration > 1 then 's' else '' end || ')' end as label,
         {r4('acc')} acc, {r4('f1_macro')} f1_macro, {r4('f1_pos')} f1_pos,
         case when length(flat) > 20 then substr(flat, 1, 20) || ' ...' else flat end excerpt
       from {cells_sql('v_iterations', 'iteration')} join (select iteration, regexp_replace(text, '\\s+', ' ', 'g') flat from texts) using (iteration)""",
)
def progression_study(v: Views):
    rows = v.iterations()
    text = F.concat(F.lit("Step "), F.col("iteration").cast("string"), F.lit("\nsays yes "), F.sum("hard").cast("string"), F.lit(" times   of "), F.count(F.lit(1)).cast("string"))
    return studies.progression_study(rows, rows, rows.groupBy("iteration").agg(text.alias("text")), limit=20)["steps"]
