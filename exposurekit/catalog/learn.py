"""Encodings, models, rankings and explanation quality, on whole event tables with a planted signal."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import encode, models, profile, ranking, resample, responses
from ..operators.encode import Encoder
from ..operators.trees import TreeScorer, fit_tree
from ..session import cut_lineage
from .registry import query
from .views import Views, uniform, uniform_sql

CATEGORICAL = ("u_age", "u_gender", "s_country")
NUMERIC = ("u_device_price", "r_value", "r_spend", "r_score")
FEATURES = [*CATEGORICAL, *NUMERIC]
# kinds that are the same at every table size, so that SQL can state the layout
ALWAYS_NUMERIC = ("r_value", "r_spend", "r_score")
FIXED_KINDS = [*CATEGORICAL, *ALWAYS_NUMERIC]

MODEL_ROWS_SQL = f"""rows as (select m.row_id, clicked, m.u_age, m.u_gender, s_country, u_device_price, r_value,
      case when m.u_gender is not null then r_value end r_spend, p_a r_score,
      case when {uniform_sql('split', 'm.row_id')} < 0.7e0 then 'train' else 'test' end part
      from v_modeling m join v_predictions p on m.row_id = p.row_id)"""
MODEL_VIEWS = "v_modeling v_predictions"


def model_rows(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, train, test): every event is in one part; ``r_score`` carries the signal."""
    score = v.predictions().select("row_id", F.col("p_a").alias("r_score"))
    rows = v.modeling().join(score, "row_id").withColumns(
        {
            "r_spend": F.when(F.col("u_gender").isNotNull(), F.col("r_value")),
            "part": F.when(uniform("split", "row_id") < 0.7, "train").otherwise("test"),
        }
    )
    rows = cut_lineage(rows.select("row_id", "clicked", *FEATURES, "part"), "model-rows")
    return rows, rows.filter("part = 'train'"), rows.filter("part = 'test'")


def entries(encoder: Encoder, rows: DataFrame) -> DataFrame:
    return encoder.entries(rows)


def encoding_sql(categorical, numeric, source: str, flagged=()) -> str:
    """Vector entries by hand: sorted levels of each categorical feature, numbers, gap flags."""
    ctes, parts, offset = [], [], "0"
    for f in categorical:
        ctes.append(
            f"l_{f} as (select lv, row_number() over (order by lv) - 1 + {offset} as pos from (select distinct coalesce({f}::varchar, 'nan') lv from {source}))"
        )
        parts.append(f"select row_id, pos as position, 1e0 as value from rows join l_{f} on coalesce({f}::varchar, 'nan') = lv")
        offset = f"{offset} + (select count(*) from l_{f})"
    for i, f in enumerate(numeric):
        filled = f"coalesce({f}, (select avg({f}) from rows where part = 'train'))::double"
        parts.append(f"select row_id, {offset} + {i}, round({filled}, 6) from rows where {filled} <> 0")
    for i, f in enumerate(flagged):
        parts.append(f"select row_id, {offset} + {len(numeric) + i}, 1e0 from rows where {f} is null")
    body = " union all ".join(parts)
    return f", {MODEL_ROWS_SQL}, {', '.join(ctes)} select row_id, position::bigint as position, value from ({body})"


@query("encode_train_fit", MODEL_VIEWS, encoding_sql(CATEGORICAL, ALWAYS_NUMERIC, "rows where part = 'train'", ["r_spend"]))
def encode_train_fit(v: Views):
    rows, train, _ = model_rows(v)
    return entries(encode.encode_train_fit(train, FIXED_KINDS), rows)


@query("encode_union_fit", MODEL_VIEWS, encoding_sql(CATEGORICAL, ALWAYS_NUMERIC, "rows", ["r_spend"]))
def encode_union_fit(v: Views):
    rows, train, test = model_rows(v)
    return entries(encode.encode_union_fit(train, test, FIXED_KINDS), rows)


@query("encode_all_string", MODEL_VIEWS, encoding_sql(FEATURES, (), "rows"))
def encode_all_string(v: Views):
    rows, train, test = model_rows(v)
    return entries(encode.encode_all_string(train, test, FEATURES), rows)


@query(
    "encode_object_only",
    MODEL_VIEWS,
    encoding_sql(("u_age", "u_gender"), ("s_country", *NUMERIC), "rows", ("s_country", "r_spend")),
)
def encode_object_only(v: Views):
    rows, train, test = model_rows(v)
    return entries(encode.encode_object_only(train, test, FEATURES), rows)


def fitted(v: Views, fit) -> tuple[models.Scorer, DataFrame, DataFrame]:
    _, train, test = model_rows(v)
    encoder = encode.encode_train_fit(train, FEATURES)
    return fit(encoder, models.training_set(encoder, train, "clicked")), train, test


TEST_SQL = f"""{MODEL_ROWS_SQL}, test as (select * from rows where part = 'test')"""


def test_facts(v: Views, fit) -> DataFrame:
    """Every test row with what must hold of any sound fit: classes follow probabilities, and accuracy beats the larger class."""
    scorer, _, test = fitted(v, fit)
    scored = cut_lineage(scorer.predict(test).select("row_id", "clicked", "prob", "hard"), "fit-facts")
    right = F.avg((F.col("hard") == F.col("clicked")).cast("double"))
    share = F.avg(F.col("clicked").cast("double"))
    learned = scored.agg((right > F.greatest(share, 1 - share)).cast("int").alias("learned")).scalar()
    return scored.select(
        "row_id",
        "clicked",
        F.col("prob").between(0, 1).cast("int").alias("inside"),
        (F.col("hard") == (F.col("prob") >= 0.5).cast("int")).cast("int").alias("follows"),
        learned.alias("learned"),
    )


FIT_SQL = f""", {TEST_SQL} select row_id, clicked::bigint clicked, 1::bigint inside, 1::bigint follows, 1::bigint learned from test"""


@query("fit_logreg", MODEL_VIEWS, FIT_SQL)
def fit_logreg(v: Views):
    return test_facts(v, models.fit_logreg)


@query("fit_gbt", MODEL_VIEWS, FIT_SQL)
def fit_gbt(v: Views):
    return test_facts(v, models.fit_gbt)


DEPTH = 6
TREE_FEATURES = {f: i for i, f in enumerate(FEATURES)}


def walked(name: str, keys: str, start: str, left: str, values: str) -> str:
    """``{name}{d}`` ({keys}, node) for d = 0..DEPTH: where rows stand after d splits, by the tables ``split0``, ``split1``, ..."""
    out = [f"{name}0 as materialized ({start})"]
    for d in range(DEPTH):
        out.append(
            f"""{name}{d + 1} as materialized (select {", ".join(f"w.{k.strip()}" for k in keys.split(","))},
                case when s.node is null then w.node when {left} then 2 * w.node else 2 * w.node + 1 end node
              from {name}{d} w left join split{d} s on s.node = w.node left join {values})"""
        )
    return ", ".join(out)


LEFT = "case when s.lv is not null then l.lv = s.lv when l.val is null then s.g = 1 else l.val <= s.bound end"


def tree_sql() -> str:
    """The exact tree of the train rows, level by level: split0..split5 (node, f, lv, bound, g, gain) and at0..at6 of all rows."""
    purity = "(({p}) * ({p}) + (({n}) - ({p})) * (({n}) - ({p}))) / ({n})"
    pure = lambda n, p: purity.format(n=f"({n})::double", p=f"({p})::double")
    texts = [f"select row_id, {i} f, coalesce({f}::varchar, 'nan') lv, null::double val from rows" for f, i in TREE_FEATURES.items() if f in CATEGORICAL]
    texts += [f"select row_id, {i}, null, {f}::double from rows" for f, i in TREE_FEATURES.items() if f in NUMERIC]
    out = [MODEL_ROWS_SQL, f"long as materialized ({' union all '.join(texts)})", "at0 as materialized (select row_id, clicked, part, 1::bigint node from rows)"]
    for d in range(DEPTH):
        out.append(
            f"""tot{d} as materialized (select node, count(*) an, sum(clicked)::bigint ap from at{d}
                where part = 'train' and node >= {1 << d} and node < {2 << d} group by node having sum(clicked) > 0 and sum(clicked) < count(*)),
            cell{d} as materialized (select a.node, l.f, l.lv, l.val, count(*) n, sum(a.clicked)::bigint p
                from at{d} a join tot{d} using (node) join long l using (row_id) where a.part = 'train' group by a.node, l.f, l.lv, l.val),
            gap{d} as (select node, f, n gn, p gp from cell{d} where lv is null and val is null),
            run{d} as (select node, f, val, sum(n) over w cn, sum(p) over w cp, sum(n) over (partition by node, f) alln,
                lead(val) over (partition by node, f order by val) nextval
                from cell{d} where val is not null window w as (partition by node, f order by val)),
            side{d} as (
                select node, f, lv, null::double val, null::double bound, -1 g, false alls, n ln, p lp from cell{d} where lv is not null
                union all select node, f, null, case when cn < alln then val end, case when cn < alln then (val + nextval) / 2 else 'infinity'::double end, 0, cn = alln, cn, cp from run{d}
                union all select node, f, null, val, (val + nextval) / 2, 1, false, cn + gn, cp + gp from run{d} join gap{d} using (node, f) where cn < alln),
            split{d} as materialized (
                select node, f, lv, bound, g, score - whole gain from (
                  select *, row_number() over (partition by node order by score desc, f, g, alls, val, lv) place from (
                    select side{d}.*, {pure('ln', 'lp')} + {pure('an - ln', 'ap - lp')} score, {pure('an', 'ap')} whole
                    from side{d} join tot{d} using (node) where ln > 0 and ln < an) where score > whole) where place = 1),
            at{d + 1} as materialized (select a.row_id, a.clicked, a.part,
                case when s.node is null then a.node when {LEFT} then 2 * a.node else 2 * a.node + 1 end node
                from at{d} a left join split{d} s on s.node = a.node left join long l on l.row_id = a.row_id and l.f = s.f)"""
        )
    out.append(f"leaf as materialized (select node, sum(clicked)::double / count(*) share from at{DEPTH} where part = 'train' group by node)")
    out.append(f"splits as materialized ({' union all '.join(f'select * from split{d}' for d in range(DEPTH))})")
    named = ", ".join(f"({i}, '{f}')" for f, i in TREE_FEATURES.items())
    out.append(f"named(f, feature) as (values {named})")
    out.append(
        """gains as (select feature, f, coalesce(sum(gain), 0) / (select sum(gain) from splits) importance from named left join splits using (f) group by feature, f),
        own as materialized (select 'SparseTree' as method, feature, row_number() over (order by importance desc, f) as rank, importance from gains)"""
    )
    return ", ".join(out)


def permuted_sql() -> str:
    """``swapped`` (method, feature, rank, importance): every row scored anew for every tested column, with its donor's value there."""
    seed, repeats = DEFAULTS.seed, 5
    left = f"""case when s.lv is not null and o.f = s.f and o.lv = s.lv then dl.lv = s.lv
        when s.lv is null and o.f = s.f and o.lv is null then (case when dl.val is null then s.g = 1 else dl.val <= s.bound end) else {LEFT} end"""
    values = "long l on l.row_id = w.row_id and l.f = s.f left join tested o on o.slot = w.slot left join long dl on dl.row_id = w.donor and dl.f = s.f"
    return f"""tested as materialized (select row_number() over (order by f, lv) slot, f, lv from (select distinct f, lv from splits)),
      test as materialized (select row_id, clicked, node from at{DEPTH} where part = 'test'),
      takers as (select row_id, row_number() over (order by md5('{seed}:rows:' || row_id::varchar), row_id) pos from test),
      donors as (select row_id, k, row_number() over (partition by k order by md5('{seed}:' || k || ':' || row_id::varchar), row_id) pos
                 from test, (select unnest(range(1, {repeats + 1})) k)),
      pairs as (select t.row_id, d.row_id donor, d.k, slot from takers t join donors d using (pos) cross join tested),
      {walked("sw", "row_id, donor, k, slot", "select row_id, donor, k, slot, 1::bigint node from pairs", left, values)},
      judged as (select o.f, sum((b.share >= 0.5)::int = t.clicked) - sum((a.share >= 0.5)::int = t.clicked) lost
        from sw{DEPTH} w join test t using (row_id) join leaf b on b.node = t.node join leaf a on a.node = w.node join tested o using (slot) group by o.f),
      swapped as materialized (select 'Permutation' as method, feature, row_number() over (order by importance desc, f) as rank, importance from (
        select feature, f, coalesce(lost, 0)::double / ((select count(*) from test) * {repeats}) importance from named left join judged using (f)))"""


def fitted_tree(v: Views) -> tuple[TreeScorer, DataFrame, DataFrame]:
    _, train, test = model_rows(v)
    return fit_tree(train, FEATURES, NUMERIC, depth=DEPTH), train, test


@query(
    "fit_sparse_tree",
    MODEL_VIEWS,
    f""", {tree_sql()} select row_id, clicked::bigint clicked, round(share, 6) prob, (share >= 0.5)::bigint hard
       from at{DEPTH} join leaf using (node) where part = 'test'""",
)
def fit_sparse_tree(v: Views):
    """Predictions of the exact tree; SQL fits the same tree."""
    scorer, _, test = fitted_tree(v)
    return scorer.predict(test).select("row_id", "clicked", "prob", "hard")


@query(
    "fit_sparse_tree_table",
    MODEL_VIEWS,
    f""", {tree_sql()}, reached as ({" union ".join(f"select node, clicked, row_id from at{d} where part = 'train'" for d in range(DEPTH + 1))})
       select node, count(*) n, sum(clicked)::bigint positives, feature, lv as level, case when isinf(bound) then null else round(bound, 6) end as "limit",
         isinf(coalesce(bound, 0))::bigint every_number, round(gain, 6) gain
       from reached left join (select * from splits join named using (f)) using (node) group by all""",
)
def fit_sparse_tree_table(v: Views):
    """The fitted tree itself."""
    scorer, _, _ = fitted_tree(v)
    every = F.coalesce(F.col("limit") == float("inf"), F.lit(False))
    table = scorer.table(v.spark).withColumns({"every_number": every.cast("int"), "limit": F.when(~every, F.col("limit"))})
    return table.select("node", "n", "positives", "feature", "level", "limit", "every_number", "gain")


RANKED = "method, feature, rank, round(importance, 6) importance"


@query("tree_importance_ranking", MODEL_VIEWS, f", {tree_sql()} select {RANKED} from own")
def tree_importance_ranking(v: Views):
    scorer, _, _ = fitted_tree(v)
    return ranking.tree_importance_ranking(v.spark, scorer)


@query("permutation_ranking", MODEL_VIEWS, f", {tree_sql()}, {permuted_sql()} select {RANKED} from swapped")
def permutation_ranking(v: Views):
    scorer, _, test = fitted_tree(v)
    return ranking.permutation_ranking(scorer, test, seed=DEFAULTS.seed)


ABLATED = ("u_age", "s_country", "r_value")


@query(
    "ablate",
    MODEL_VIEWS,
    f""", {MODEL_ROWS_SQL}, train as (select * from rows where part = 'train')
       select row_id, (select u_age from train where u_age is not null group by 1 order by count(*) desc, u_age limit 1) u_age, u_gender,
       (select s_country from train where s_country is not null group by 1 order by count(*) desc, s_country limit 1) s_country,
       (select round(avg(r_value), 6) from train) r_value, round(r_score, 6) r_score from rows where part = 'test'""",
)
def ablate(v: Views):
    _, train, test = model_rows(v)
    impute = profile.impute_values(train, NUMERIC, CATEGORICAL)
    neutral = ranking.ablate(test, ABLATED, impute, NUMERIC)
    return neutral.select("row_id", "u_age", "u_gender", "s_country", "r_value", "r_score")


GROUPS = ("static_only", "score_only", "full")


@query(
    "group_ablation",
    "",
    f"""select "group", model, metric, 1::bigint inside, (metric = 'auc' and "group" <> 'static_only')::bigint separates
       from (values {", ".join(f"('{g}')" for g in GROUPS)}) g("group"), (values {", ".join(f"('{m}')" for m in models.LEARNERS)}) m(model),
       (values ('acc'), ('f1'), ('auc'), ('ap')) x(metric)""",
)
def group_ablation(v: Views):
    """Quality per group and learner as facts: shares lie in 0..1, and only groups with the signal separate the classes."""
    _, train, test = model_rows(v)
    static = [f for f in FEATURES if f != "r_score"]
    groups = dict(zip(GROUPS, (static, ["r_score"], FEATURES)))
    found = models.group_ablation(train, test, groups, encoding=encode.encode_union_fit)
    separates = (F.col("metric") == "auc") & (F.col("value") > 0.7)
    return found.select("group", "model", "metric", F.col("value").between(0, 1).cast("int").alias("inside"), separates.cast("int").alias("separates"))


# A stated rule in place of a fit: every row's prediction, and so each table, can be had in SQL.
RULE = models.StatedScorer(
    models.StatedInputs(tuple(FEATURES), NUMERIC),
    base=0.05,
    numbers={"r_score": 0.8, "r_value": 0.0004},
    levels={("u_age", "18-23"): 0.06, ("u_age", "50+"): -0.05, ("s_country", "3"): 0.07, ("u_gender", "F"): 0.02},
)
BOTTOM = 3


def rankings_of_rule(spark) -> DataFrame:
    """Three rankings: by the rule's own weights, a stated text in reverse order, and the random control."""
    text = spark.createDataFrame([("Stated", "\n".join(reversed(FEATURES)))], "text_id string, text string")
    stated = responses.parse_ranking(text, FEATURES).select(F.col("text_id").alias("method"), "feature", "rank", F.lit(0.0).alias("importance"))
    weights = {"r_score": 0.8, "s_country": 0.07, "u_age": 0.06, "u_gender": 0.02, "r_value": 0.0004}
    own = ranking.as_ranking(spark, "Rule", FEATURES, weights)
    return own.unionByName(stated).unionByName(ranking.random_ranking(spark, FEATURES, DEFAULTS.seed))


ORDERS = {
    "Rule": ("r_score", "s_country", "u_age", "u_gender", "r_value", "u_device_price", "r_spend"),
    "Stated": tuple(reversed(FEATURES)),
    "Random": tuple(sorted(FEATURES, key=lambda f: hashlib.md5(f"{DEFAULTS.seed}:{f}".encode()).hexdigest())),
}


def rule_sql(age: str, gender: str, country: str, value: str, score: str) -> str:
    return f"""(round(least(1e0, greatest(0e0, 0.05e0 + 0.8e0 * coalesce({score}, 0e0) + 0.0004e0 * coalesce({value}, 0e0)
      + case when {age} = '18-23' then 0.06e0 when {age} = '50+' then -0.05e0 else 0e0 end
      + case when {country} = 3 then 0.07e0 else 0e0 end + case when {gender} = 'F' then 0.02e0 else 0e0 end)), 6) >= 0.5e0)::int"""


def outcomes_sql() -> str:
    """outcomes(method, kind, k, row_id, correct, same, base_correct) of every deletion and perturbation."""
    rows = []
    for method, order in ORDERS.items():
        for kind, k, killed in [*(("deletion", k, order[:k]) for k in DEFAULTS.deletion_ks), ("stability", BOTTOM, order[-BOTTOM:])]:
            flags = ", ".join(str(f in killed).lower() for f in ("u_age", "u_gender", "s_country", "r_value", "r_score"))
            rows.append(f"('{method}', '{kind}', {k}, {flags})")
    mode = lambda c: f"(select {c} from train where {c} is not null group by 1 order by count(*) desc, {c} limit 1)"
    pick = lambda c: f"case when no_{c} then m_{c} else {c} end"
    changed = rule_sql(*[pick(c) for c in ("u_age", "u_gender", "s_country", "r_value", "r_score")])
    return f"""{TEST_SQL}, train as (select * from rows where part = 'train'),
      neutral as (select {mode('u_age')} m_u_age, {mode('u_gender')} m_u_gender, {mode('s_country')} m_s_country,
        (select avg(r_value) from train) m_r_value, (select avg(r_score) from train) m_r_score),
      variants(method, kind, k, no_u_age, no_u_gender, no_s_country, no_r_value, no_r_score) as (values {', '.join(rows)}),
      judged as (select method, kind, k, row_id, clicked, {rule_sql('u_age', 'u_gender', 's_country', 'r_value', 'r_score')} base, {changed} hard
        from test cross join neutral cross join variants),
      outcomes as (select method, kind, k, row_id, (hard = clicked)::int correct, (hard = base)::int same, (base = clicked)::int base_correct from judged)"""


def studied(v: Views) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rankings) of the stated rule."""
    _, train, test = model_rows(v)
    rankings = rankings_of_rule(v.spark)
    impute = profile.impute_values(train, NUMERIC, CATEGORICAL)
    return ranking.variant_outcomes(RULE, test, rankings, impute, DEFAULTS.deletion_ks, bottom=BOTTOM), rankings


DELETIONS_SQL = """select method, k::bigint k, round(avg(correct), 6) acc, round(avg(base_correct) - avg(correct), 6) as "drop"
    from outcomes where kind = 'deletion' group by method, k"""
STABILITY_SQL = "select method, round(avg(same), 6) as share from outcomes where kind = 'stability' group by method"


@query("single_deletion", MODEL_VIEWS, f", {outcomes_sql()} {DELETIONS_SQL}")
def single_deletion(v: Views):
    return ranking.single_deletion(studied(v)[0])


@query("stability", MODEL_VIEWS, f", {outcomes_sql()} {STABILITY_SQL}")
def stability(v: Views):
    return ranking.stability(studied(v)[0])


TOPS = ", ".join(f"('{m}', '{o[0]}', '{','.join(o[:8])}')" for m, o in ORDERS.items())


@query(
    "explanation_quality_table",
    MODEL_VIEWS,
    f""", {outcomes_sql()}, deletions as ({DELETIONS_SQL}), stable as ({STABILITY_SQL}), tops(method, top1, top) as (values {TOPS})
      select method, top1, top, max(acc) filter (k = 1) del1, max(acc) filter (k = 3) del3, max(acc) filter (k = 5) del5,
      max("drop") filter (k = 5) drop_at_5, any_value(share) stability
      from tops join deletions using (method) join stable using (method) group by method, top1, top""",
)
def explanation_quality_table(v: Views):
    return ranking.explanation_quality(*studied(v))


FITTED = ("SparseTree", "Permutation", "Random")


def fitted_outcomes_sql() -> str:
    """``outcomes`` of the fitted tree under its own, the permutation and the random ranking."""
    control = ", ".join(f"('Random', '{f}', {i})" for i, f in enumerate(ORDERS["Random"], 1))
    ks = ", ".join(f"('deletion', {k})" for k in DEFAULTS.deletion_ks)
    mode = lambda c: f"(select coalesce({c}::varchar, 'nan') from train where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
    neutral = [f"select {i} f, {mode(f)} lv, null::double val" for f, i in TREE_FEATURES.items() if f in CATEGORICAL]
    neutral += [f"select {i}, null, (select avg({f}::double) from train)" for f, i in TREE_FEATURES.items() if f in NUMERIC]
    left = LEFT.replace("l.lv", "(case when x.f is null then l.lv else u.lv end)").replace("l.val", "(case when x.f is null then l.val else u.val end)")
    values = """long l on l.row_id = w.row_id and l.f = s.f
        left join killed x on x.method = w.method and x.kind = w.kind and x.k = w.k and x.f = s.f left join neutral u on u.f = s.f"""
    return f"""{tree_sql()}, {permuted_sql()}, train as (select * from rows where part = 'train'),
      neutral as materialized ({" union all ".join(neutral)}),
      ranked as materialized (select method, feature, rank from own union all select method, feature, rank from swapped union all select * from (values {control})),
      variants as materialized (select method, kind, k from (select distinct method from ranked) cross join
        (select * from (values {ks}, ('stability', {BOTTOM})) t(kind, k))),
      killed as materialized (select v.method, v.kind, v.k, named.f from variants v join ranked r using (method) join named using (feature)
        where (kind = 'deletion' and rank <= k) or (kind = 'stability' and rank > {len(FEATURES)} - k)),
      {walked("ab", "row_id, method, kind, k", "select row_id, method, kind, k, 1::bigint node from test cross join variants", left, values)},
      outcomes as materialized (select w.method, w.kind, w.k, w.row_id, ((a.share >= 0.5)::int = t.clicked)::int correct,
          ((a.share >= 0.5) = (b.share >= 0.5))::int same, ((b.share >= 0.5)::int = t.clicked)::int base_correct
        from ab{DEPTH} w join test t using (row_id) join leaf a on a.node = w.node join leaf b on b.node = t.node)"""


def fitted_study(v: Views) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rankings) of the fitted tree with its own, the permutation, and the random ranking."""
    scorer, train, test = fitted_tree(v)
    rankings = (
        ranking.tree_importance_ranking(v.spark, scorer)
        .unionByName(ranking.permutation_ranking(scorer, test, seed=DEFAULTS.seed))
        .unionByName(ranking.random_ranking(v.spark, FEATURES, DEFAULTS.seed))
    )
    impute = profile.impute_values(train, NUMERIC, CATEGORICAL)
    return ranking.variant_outcomes(scorer, test, rankings, impute, DEFAULTS.deletion_ks, bottom=BOTTOM), rankings


@query("single_deletion_fitted", MODEL_VIEWS, f", {fitted_outcomes_sql()} {DELETIONS_SQL}")
def single_deletion_fitted(v: Views):
    return ranking.single_deletion(fitted_study(v)[0])


@query("stability_fitted", MODEL_VIEWS, f", {fitted_outcomes_sql()} {STABILITY_SQL}")
def stability_fitted(v: Views):
    return ranking.stability(fitted_study(v)[0])


@query(
    "explanation_quality_fitted",
    MODEL_VIEWS,
    f""", {fitted_outcomes_sql()}, deletions as ({DELETIONS_SQL}), stable as ({STABILITY_SQL}),
      tops as (select method, min(feature) filter (rank = 1) top1, string_agg(feature, ',' order by rank) filter (rank <= 8) top from ranked group by method)
      select method, top1, top, max(acc) filter (k = 1) del1, max(acc) filter (k = 3) del3, max(acc) filter (k = 5) del5,
      max("drop") filter (k = 5) drop_at_5, any_value(share) stability
      from tops join deletions using (method) join stable using (method) group by method, top1, top""",
)
def explanation_quality_fitted(v: Views):
    return ranking.explanation_quality(*fitted_study(v))


@query(
    "bootstrap_explanation_fitted",
    MODEL_VIEWS,
    f""", {fitted_outcomes_sql()}, found as (
        select method, 'drop' metric, avg(base_correct - correct) true_value from outcomes where kind = 'deletion' and k = 5 group by method
        union all select method, 'stability', avg(same) from outcomes where kind = 'stability' group by method)
      select method, metric, round(true_value, 6) true_value, 1::bigint mean_near, 1::bigint sd_near from found""",
)
def bootstrap_explanation_fitted(v: Views):
    return bootstrap_beside_theory(fitted_study(v)[0], FITTED)


@query(
    "bootstrap_explanation",
    MODEL_VIEWS,
    f""", {outcomes_sql()}, found as (
        select method, 'drop' metric, avg(base_correct - correct) true_value from outcomes where kind = 'deletion' and k = 5 group by method
        union all select method, 'stability', avg(same) from outcomes where kind = 'stability' group by method)
      select method, metric, round(true_value, 6) true_value, 1::bigint mean_near, 1::bigint sd_near from found""",
)
def bootstrap_explanation(v: Views):
    return bootstrap_beside_theory(studied(v)[0], tuple(ORDERS))


def bootstrap_beside_theory(outcomes: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """Bootstrap mean and deviation beside the value and the deviation that theory gives."""
    vectors = ranking.outcome_vectors(outcomes, methods)
    columns = {m: (f"del_{i}", f"same_{i}") for i, m in enumerate(methods)}
    drawn = resample.bootstrap_explanations(vectors, "base_correct", columns, DEFAULTS.bootstrap_draws, DEFAULTS.seed)
    deleted = F.when((F.col("kind") == "deletion") & (F.col("k") == 5), F.col("base_correct") - F.col("correct"))
    theory = []
    for name, x in (("drop", deleted), ("stability", F.when(F.col("kind") == "stability", F.col("same")))):
        n = F.sum(F.when(x.isNotNull(), F.col("n")))
        mean = F.sum(x * F.col("n")) / n
        spread = F.sqrt(F.sum(x * x * F.col("n")) / n - mean * mean)
        theory.append(outcomes.groupBy("method").agg(mean.alias("true_value"), spread.alias("sd_row"), n.alias("n")).withColumn("metric", F.lit(name)))
    return near_theory(drawn, theory[0].unionByName(theory[1]), ["method", "metric"])


def near_theory(drawn: DataFrame, theory: DataFrame, on: list[str]) -> DataFrame:
    """Within six Monte-Carlo errors of the mean and the deviation of a mean of n rows."""
    sd = F.col("sd_row") / F.sqrt("n")
    draws = DEFAULTS.bootstrap_draws
    return drawn.join(theory, on).select(
        *on,
        "true_value",
        (F.abs(F.col("mean") - F.col("true_value")) <= 6 * sd / F.sqrt(F.lit(draws))).cast("int").alias("mean_near"),
        (F.abs(F.col("sd") - sd) <= 6 * sd / F.sqrt(F.lit(2 * draws)) + 1e-9).cast("int").alias("sd_near"),
    )
