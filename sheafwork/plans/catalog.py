"""Named queries of the engine, each over its whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.functions import text as T
from sheafwork.functions.canon import canonical_label, document_key, label_key
from sheafwork.operators import compare, extract, profile, retrieval, rules, runs, sampling, taxonomy
from sheafwork.session import table

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}

LABEL_COLUMNS = ("document_id", "domain", "requirement_id", "requirement_type", "requirement_name", "raw_requirement_text", "requirement_type_normalized", "primary_action", "primary_action_model",
                 "blockers", "cost_basis", "domain_dependency", "build_difficulty", "reasoning", "execution_path", "source_run")
#: SQL of the records: one latest row per requirement.
REC = "rec as (select * from label_dataset_v2 where requirement_uid is not null qualify row_number() over (partition by requirement_uid order by built_at desc) = 1)"
#: SQL of each annotator's latest successful answer.
ANS = "ans as (select * from results where status = 'ok' and label is not null qualify row_number() over (partition by requirement_uid, annotator_id order by received_at desc) = 1)"
#: SQL of label keys: letters and digits only.
KEY = "regexp_replace(nfc_normalize({}), '[^가-힣A-Za-z0-9]', '', 'g')"
#: SQL of the sorted distinct keys of a list of labels, as one text.
KEYS = "array_to_string(list_sort(list_distinct(list_filter(list_transform({}, lambda b: " + KEY.format("b") + "), lambda b: b <> ''))), '|')"
#: SQL of the key of a document identifier.
DOC = "regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '\\.md$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
SPACE_SQL = T.SPACE


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sheafwork.plans import more  # noqa: F401  (registers its queries)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def records(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Latest row of each requirement with the given columns only."""
    return profile.latest(table(s, d, "label_dataset_v2"), "requirement_uid", "built_at", *columns)


def answers(s: SparkSession, d: str) -> DataFrame:
    return runs.latest_ok(table(s, d, "results"), "requirement_uid", "annotator_id", carry=("strategy", "received_at", "run_name"))


def key(c: str):
    return label_key(F.col(c))


# --- profiling -------------------------------------------------------------------------------------------------------


@query(f"""with {REC}, c as (select document_id, {KEY.format('primary_action')} as action, count(*) as n from rec group by all)
select document_id, sum(n)::bigint as n, max(n)::bigint as top, max(n) / sum(n) as baseline from c group by document_id""")
def a24_majority_baseline(s, d):
    c = profile.counts(records(s, d, "document_id", "primary_action").select("document_id", key("primary_action").alias("action")), "document_id", "action")
    return c.groupBy("document_id").agg(F.sum("n").alias("n"), F.max("n").alias("top")).withColumn("baseline", F.col("top") / F.col("n"))


@query(f"with {REC} select document_id, coalesce(requirement_type, 'None') as requirement_type, count(*) as n from rec group by all")
def a2_crosstab(s, d):
    r = records(s, d, "document_id", "requirement_type")
    return profile.counts(r, "document_id", F.coalesce("requirement_type", F.lit("None")).alias("requirement_type"))


def _stats(length: str, by: str = "") -> str:
    q = ", ".join(f"quantile_cont({length}, {p}) as p{int(p * 100)}" for p in profile.QUANTILES)
    return f"count({length}) as n, min({length})::int as least, max({length})::int as most, sum({length}) / count({length}) as mean, {q}"


@query(f"with {REC} select {_stats('length(raw_requirement_text)')} from rec")
def a3_length_stats(s, d):
    return profile.length_stats(records(s, d, "raw_requirement_text"), F.length("raw_requirement_text"))


@query(f"with {REC} select document_id, {_stats('length(raw_requirement_text)')} from rec group by document_id")
def a4_length_by_document(s, d):
    return profile.length_stats(records(s, d, "document_id", "raw_requirement_text"), F.length("raw_requirement_text"), ("document_id",))


@query("select requirement_uid, count(*) as n from label_dataset_v2 group by 1 having count(*) > 1")
def a5_duplicate_keys(s, d):
    return profile.duplicate_keys(table(s, d, "label_dataset_v2"), "requirement_uid")


@query(f"with {REC} select count(*) as rows, count(*) filter (where coalesce(agency, '') = '') as no_agency, count(*) filter (where coalesce(domain, '') = '') as no_domain, count(*) filter (where coalesce(requirement_type, '') = '') as no_type, count(*) filter (where coalesce(raw_requirement_text, '') = '') as no_text, count(*) filter (where rule_corrected) as corrected from rec")
def a10_null_counts(s, d):
    r = records(s, d, "agency", "domain", "requirement_type", "raw_requirement_text", "rule_corrected")
    empty = lambda c: F.count_if(F.coalesce(c, F.lit("")) == "")
    return r.agg(F.count(F.lit(1)).alias("rows"), empty("agency").alias("no_agency"), empty("domain").alias("no_domain"), empty("requirement_type").alias("no_type"), empty("raw_requirement_text").alias("no_text"), F.count_if("rule_corrected").alias("corrected"))


@query(f"""with {REC}, u as (select 'execution_path' as "column", execution_path as value from rec union all select 'source_run', source_run from rec union all select 'cost_basis', cost_basis from rec)
select "column", value, count(*) as n from u group by all""")
def a11_manifest_counts(s, d):
    from sheafwork.sources.writers import counts_manifest

    return counts_manifest(records(s, d, "execution_path", "source_run", "cost_basis"), "execution_path", "source_run", "cost_basis")


@query(f"with {REC}, c as (select {KEY.format('primary_action')} as action, count(*) as n from rec group by all) select action, n, n / sum(n) over () as share from c")
def a16_distribution(s, d):
    return profile.shares(records(s, d, "primary_action").select(key("primary_action").alias("action")), "action")


def _category_sql(c: str = "requirement_id") -> str:
    p = f"case when instr({c}, '-') > 0 then trim(split_part({c}, '-', 1)) else substring({c}, 1, 3) end"
    whens = " ".join(f"when {p} in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in taxonomy.CATEGORIES.items())
    return f"case {whens} else '{taxonomy.OTHER_CATEGORY}' end"


@query(f"with {REC}, c as (select {_category_sql()} as category, {KEY.format('primary_action')} as action, count(*) as n from rec group by all) select category, action, n, n / sum(n) over (partition by category) as share, (sum(n) over (partition by category))::bigint as category_total from c")
def a17_category_label(s, d):
    r = records(s, d, "requirement_id", "primary_action").select(taxonomy.category(F.col("requirement_id")).alias("category"), key("primary_action").alias("action"))
    return profile.shares(r, "action", ("category",)).withColumn("category_total", F.sum("n").over(Window.partitionBy("category")))


@query(f"""with {REC}, c as (select document_id, {_category_sql()} as category, count(*) as n from rec group by all), t as (select *, sum(n) over (partition by document_id) as total, row_number() over (partition by document_id order by n desc, category) as k from c)
select document_id, category, n, n / total as share from t where k = 1""")
def a21_dominant_category(s, d):
    return profile.dominant(records(s, d, "document_id", "requirement_id").select("document_id", taxonomy.category(F.col("requirement_id")).alias("category")), "document_id", "category")


@query(f"""with {REC} select document_id, count(*) as n, avg(case when {KEY.format('primary_action')} = '통상수용' then 1.0 else 0.0 end) as accept_share, avg(case when len(blockers) > 0 then 1.0 else 0.0 end) as blocker_share,
coalesce(sum(length(raw_requirement_text)), 0)::bigint as chars from rec group by document_id""")
def a23_document_stats(s, d):
    r = records(s, d, "document_id", "primary_action", "blockers", "raw_requirement_text").withColumn("action", key("primary_action"))
    yes = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return r.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), yes(F.col("action") == "통상수용").alias("accept_share"), yes(F.size("blockers") > 0).alias("blocker_share"), F.coalesce(F.sum(F.length("raw_requirement_text")), F.lit(0)).alias("chars"))


@query(f"""with {REC}, c as (select requirement_type_normalized, document_id, count(*) as n from rec group by all)
select requirement_type_normalized, sum(n)::bigint as n, count(document_id) as documents, count(document_id) < 8 as few_documents, max(n) / min(n) as ratio from c group by 1""")
def a25_type_stats(s, d):
    c = profile.counts(records(s, d, "document_id", "requirement_type_normalized"), "requirement_type_normalized", "document_id")
    g = c.groupBy("requirement_type_normalized").agg(F.sum("n").alias("n"), F.count("document_id").alias("documents"), (F.max("n") / F.min("n")).alias("ratio"))
    return g.withColumn("few_documents", F.col("documents") < 8)


@query(f"""with {REC}, b as (select requirement_uid, list_sort(list_distinct(blockers)) as s from rec), e as (select requirement_uid, unnest(s) as x from b)
select a.x as a, b.x as b, count(*) as n from e a join e b on a.requirement_uid = b.requirement_uid and a.x < b.x group by all""")
def a26_cooccurrence(s, d):
    return profile.pair_counts(records(s, d, "blockers"), "blockers")


@query(f"""with {REC}, m as (select document_id from rec group by 1 having count(distinct execution_path) > 1), c as (select document_id, execution_path, {KEY.format('primary_action')} as action, count(*) as n from rec where document_id in (select document_id from m) group by all)
select *, n / sum(n) over (partition by document_id, execution_path) as share from c""")
def a27_confounding(s, d):
    r = records(s, d, "document_id", "execution_path", "primary_action").select("document_id", "execution_path", key("primary_action").alias("action"))
    mixed = r.groupBy("document_id").agg(F.min("execution_path").alias("lo"), F.max("execution_path").alias("hi")).where("lo <> hi").select("document_id")
    return profile.shares(r.join(mixed, "document_id", "left_semi"), "action", ("document_id", "execution_path"))


@query(f"""with {REC}, f as (select unnest([{", ".join(f"{{'signal': '{k}', 'hit': coalesce(regexp_matches(raw_requirement_text, '{p}'), false)}}" for k, p in T.SIGNALS.items())}]) as x from rec)
select x.signal as signal, count(*) filter (where x.hit) as n, avg(case when x.hit then 1.0 else 0.0 end) as share from f group by 1""")
def a33_signals(s, d):
    flags = T.signal_flags(F.col("raw_requirement_text"))
    r = records(s, d, "raw_requirement_text").select(F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), c.alias("hit")) for k, c in flags.items()])).alias("x")).select("x.*")
    return r.groupBy("signal").agg(F.count_if("hit").alias("n"), F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("share"))


@query(f"with {REC} select md5(raw_requirement_text) as text_md5, count(*) as n, min(requirement_uid) as first_uid from rec where raw_requirement_text is not null group by 1 having count(*) > 1")
def a34_exact_duplicates(s, d):
    r = records(s, d, "raw_requirement_text").where("raw_requirement_text is not null").select("requirement_uid", F.md5("raw_requirement_text").alias("text_md5"))
    return r.groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"), F.min("requirement_uid").alias("first_uid")).where("n > 1")


@query("""with u as (select strategy, coalesce(usage.input_tokens, 0) as i, coalesce(usage.output_tokens, 0) as o, coalesce(usage.cache_creation_input_tokens, 0) as w, coalesce(usage.cache_read_input_tokens, 0) as r from results)
select strategy, grouping(strategy)::int as is_total, count(*) as calls, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, sum(w)::bigint as cache_creation_input_tokens, sum(r)::bigint as cache_read_input_tokens, (sum(i) * 3 + sum(o) * 15)::bigint as cost_millionths from u group by rollup(strategy)""")
def a36_usage_cost(s, d):
    u = runs.usage_totals(table(s, d, "results"), "strategy")
    return u.withColumn("cost_millionths", runs.cost(F.col("input_tokens"), F.col("output_tokens"), 3, 15))


@query(f"with {REC} select least(floor((length(raw_requirement_text) - 0.0) / 100.0), 59)::int as bin, count(*) as n from rec where length(raw_requirement_text) between 0 and 6000 group by 1")
def a40_histogram(s, d):
    return profile.histogram(records(s, d, "raw_requirement_text").withColumn("length", F.length("raw_requirement_text")), "length", 0.0, 6000.0, 60)


# --- text and types --------------------------------------------------------------------------------------------------


@query("select doc_id, length(text) as chars, case when c = '' then 0 else len(string_split(c, ' ')) end::int as words, contains(text, ' | ') as nested, replace(substring(text, 1, 100), chr(10), ' ') as snippet from (select *, trim(regexp_replace(text, '[" + SPACE_SQL + "]+', ' ', 'g'), ' ') as c from documents)")
def n10_text_measures(s, d):
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", F.length(t).alias("chars"), T.word_count(t).alias("words"), t.contains(" | ").alias("nested"), T.snippet(t).alias("snippet"))


@query()
def n1_model_text(s, d):
    r = records(s, d, "requirement_name", "raw_requirement_text")
    return r.select("requirement_uid", F.md5(T.model_text(F.col("requirement_name"), F.col("raw_requirement_text"), "flat")).alias("flat_md5"))


def _display_sql() -> str:
    whens = " ".join("when " + " or ".join(f"contains(requirement_type, '{k}')" for k in keys) + f" then '{n}'" for n, keys in taxonomy.DISPLAY_RULES)
    return f"case when coalesce(requirement_type, '') in ('', 'None') then '미지정 (None)' {whens} else '{taxonomy.UNKNOWN}' end"


def _map_sql(d: dict, e: str) -> str:
    return f"case {e} " + " ".join(f"when '{k}' then '{v}'" for k, v in d.items()) + " end"


_SPELL = r"nullif(replace(replace(regexp_replace(requirement_type, '\([A-Z]{2,4}\)', '', 'g'), ' ', ''), '요구사항', ''), '')"


@query(f"with {REC} select {_display_sql()} as display_type, count(*) as n from rec group by 1")
def t_display_types(s, d):
    return profile.counts(records(s, d, "requirement_type"), taxonomy.display_type(F.col("requirement_type")).alias("display_type"))


@query(f"""with {REC}, t as (select requirement_uid, {_SPELL} as spelling, {_map_sql(taxonomy.TEXT_TYPES, _SPELL)} as by_text, {_map_sql(taxonomy.PREFIX_TYPES, "split_part(requirement_id, '-', 1)")} as by_prefix from rec)
select requirement_uid, coalesce(by_text, by_prefix, '{taxonomy.UNKNOWN}') as canonical_type, case when by_text is not null then 'text' when by_prefix is not null then 'prefix' else 'none' end as type_source from t""")
def t_canonical_types(s, d):
    return taxonomy.with_types(records(s, d, "requirement_type", "requirement_id")).select("requirement_uid", "canonical_type", "type_source")


@query(f"""with {REC}, x as (select requirement_uid, case when coalesce({KEYS.format('blockers')}, '') <> '' then '계약·질의검토' when coalesce({KEY.format('cost_basis')}, '없음') <> '없음' then '견적반영' else '통상수용' end as derived_action, primary_action from rec)
select requirement_uid, derived_action, {KEY.format('derived_action')} is distinct from {KEY.format('primary_action')} as corrected from x""")
def t_rule_correction(s, d):
    return rules.correct(records(s, d, "primary_action", "blockers", "cost_basis")).select("requirement_uid", "derived_action", "corrected")


@query(f"""with {REC}, v as (select requirement_uid, list_filter([
case when not coalesce(length(requirement_uid) > 0, false) then 'requirement_uid' end,
case when not coalesce(primary_action in {rules.ACTIONS}, false) then 'primary_action' end,
case when blockers is null or len(list_filter(blockers, lambda x: x is null or x not in {rules.BLOCKERS})) > 0 then 'blockers' end,
case when not coalesce(cost_basis in {rules.COST_BASES}, false) then 'cost_basis' end,
case when not coalesce(domain_dependency in {rules.LEVELS}, false) then 'domain_dependency' end,
case when not coalesce(build_difficulty in {rules.LEVELS}, false) then 'build_difficulty' end,
case when not coalesce(length(reasoning) between 1 and 300, false) then 'reasoning' end], lambda x: x is not null) as bad from rec)
select requirement_uid, array_to_string(bad, ',') as violations from v where len(bad) > 0""")
def v1_violations(s, d):
    r = records(s, d, "primary_action", "blockers", "cost_basis", "domain_dependency", "build_difficulty", "reasoning")
    bad = rules.violations(F.col("requirement_uid"), {c: F.col(c) for c in r.columns})
    return r.select("requirement_uid", F.array_join(bad, ",").alias("violations")).where("violations <> ''")


# --- runs ------------------------------------------------------------------------------------------------------------


@query(f"with {ANS} select requirement_uid, annotator_id, label.primary_action as primary_action, label.cost_basis as cost_basis from ans")
def s8_latest_answers(s, d):
    return answers(s, d).select("requirement_uid", "annotator_id", "label.primary_action", "label.cost_basis")


def _axes(of: str) -> str:
    one = [f"{{'axis': '{a}', 'value': {(KEYS if a == 'blockers' else KEY).format(of + a)}}}" for a in runs.AXES]
    return f"unnest([{', '.join(one)}])"


_AXES = f"x as (select requirement_uid, annotator_id, strategy, {_axes('label.')} as v from ans), ax as (select requirement_uid, annotator_id, strategy, v.axis as axis, v.value as value from x)"


@query(f"with {ANS}, {_AXES}, g as (select requirement_uid, strategy, axis, count(*) as n, count(distinct coalesce(value, '')) as k from ax group by all having count(*) >= 2) select strategy, axis, count(*) as n, avg(case when k = 1 then 1.0 else 0.0 end) as unanimous from g group by all")
def a13_field_agreement(s, d):
    u = runs.unanimity(runs.axis_values(answers(s, d), "requirement_uid", "annotator_id", "strategy"), ("requirement_uid", "strategy", "axis"))
    return u.groupBy("strategy", "axis").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("unanimous"), 1.0).otherwise(0.0)).alias("unanimous"))


@query(f"""with {ANS}, v as (select requirement_uid, struct_pack(t := received_at, a := annotator_id) as seen, {KEY.format('label.primary_action')} as action from ans), c as (select requirement_uid, action, count(*) as n, min(seen) as f from v group by all),
w as (select *, sum(n) over (partition by requirement_uid) as answers, row_number() over (partition by requirement_uid order by n desc, f) as k from c) select requirement_uid, action, n as votes, answers::bigint as answers from w where k = 1""")
def a14_majority_vote(s, d):
    v = answers(s, d).withColumn("a", F.col("label.primary_action")).select("requirement_uid", F.struct("received_at", "annotator_id").alias("seen"), key("a").alias("action"))
    return runs.majority(v, "requirement_uid", "action", "seen")


_DOMAIN = ("통상수용", "견적반영", "계약질의검토")


@query(f"""with {REC}, {ANS}, v as (select requirement_uid, struct_pack(t := received_at, a := annotator_id) as seen, {KEY.format('label.primary_action')} as action from ans), c as (select requirement_uid, action, count(*) as n, min(seen) as f from v group by all),
m as (select requirement_uid, action from c qualify row_number() over (partition by requirement_uid order by n desc, f) = 1),
j as (select {KEY.format('primary_action')} as before, m.action as after, count(*) as n from rec join m using (requirement_uid) group by all), dom as (select unnest({list(_DOMAIN)}) as x)
select a.x as before, b.x as after, coalesce(j.n, 0) as n from dom a cross join dom b left join j on j.before = a.x and j.after = b.x""")
def a15_transitions(s, d):
    now = records(s, d, "primary_action").select("requirement_uid", key("primary_action").alias("action"))
    return runs.transitions(now, a14_majority_vote(s, d).select("requirement_uid", "action"), "requirement_uid", "action", _DOMAIN)


@query("""with a as (select strategy, unnest(anchors_used) as a from results), b as (select strategy, round(a.similarity * 10000)::bigint as s from a where a.similarity is not null), g as (select strategy, count(*) as n, sum(s) / count(*) as mean, max(s) as most from b group by 1)
select strategy, n, mean, most, (mean - (select mean from g where strategy = 'fewshot-similarity')) / (select mean from g where strategy = 'fewshot-similarity') as change from g""")
def a19_similarity_by_strategy(s, d):
    a = table(s, d, "results").select("strategy", F.explode("anchors_used").alias("a")).select("strategy", F.round(F.col("a.similarity") * 10000).cast("bigint").alias("similarity"))
    return compare.similarity_change(a, "strategy", "fewshot-similarity")


@query("with a as (select unnest(anchors_used) as a from results) select a.requirement_uid as requirement_uid, count(*) as uses, sum(round(a.similarity * 10000))::bigint as similarity_sum, max(round(a.similarity * 10000))::bigint as similarity_max from a group by 1")
def a31_anchor_usage(s, d):
    return runs.anchor_usage(table(s, d, "results"))


@query(f"""with {REC}, {ANS}, {_AXES}, l as (select requirement_uid, {_axes('')} as v from rec)
select ax.axis as axis, count(*) as n, avg(case when ax.value is not distinct from l.v.value then 1.0 else 0.0 end) as agreement, avg(case when ax.value is not distinct from l.v.value then 1.0 else 0.0 end) >= {compare.REPEAT_BASELINE} as as_good_as_repeats
from ax join l on l.requirement_uid = ax.requirement_uid and l.v.axis = ax.axis group by 1""")
def a42_run_agreement(s, d):
    a = runs.axis_values(answers(s, d), "requirement_uid", "annotator_id").drop("annotator_id")
    r = records(s, d, *runs.AXES).select("requirement_uid", F.struct(*runs.AXES).alias("label"))
    return compare.verdicts(runs.agreement(a, runs.axis_values(r, "requirement_uid"), "requirement_uid"))


@query(f"with {REC} select requirement_uid from rec where requirement_uid not in (select requirement_uid from results where status = 'ok' and requirement_uid is not null)")
def j7_pending(s, d):
    return runs.pending(table(s, d, "label_dataset_v2").select("requirement_uid").where("requirement_uid is not null").distinct(), table(s, d, "results"))


@query(f"""with {REC}, s as (select distinct requirement_uid from split_assignment where split = 'test'), p as (select domain, count(*) / (select count(*) from rec) as population from rec group by 1),
q as (select domain, count(*) / (select count(*) from rec join s using (requirement_uid)) as sample from rec join s using (requirement_uid) group by 1), k as (select distinct coalesce(domain, '(none)') as domain from rec)
select k.domain, coalesce(p.population, 0.0) as population, coalesce(q.sample, 0.0) as sample, coalesce(q.sample, 0.0) - coalesce(p.population, 0.0) as gap from k left join p on coalesce(p.domain, '(none)') = k.domain left join q on coalesce(q.domain, '(none)') = k.domain""")
def j14_distribution_gap(s, d):
    r = records(s, d, "domain").na.fill("(none)", ["domain"])
    test = table(s, d, "split_assignment").where("split = 'test'").select("requirement_uid").distinct()
    return profile.distribution_gap(r, r.join(test, "requirement_uid", "left_semi"), "domain")


@query("""with u as (select requirement_uid, nullif(requirement_type_normalized, '') as t, 0 as r from label_dataset_v2 union all select requirement_uid, nullif(requirement_type, ''), 1 from anchor_candidates_quote)
select requirement_uid, max_by(t, struct_pack(a := r, b := t)) as type from u where t is not null and requirement_uid is not null group by 1""")
def u5_override_union(s, d):
    a = table(s, d, "label_dataset_v2").select("requirement_uid", F.col("requirement_type_normalized").alias("type"))
    b = table(s, d, "anchor_candidates_quote").select("requirement_uid", F.col("requirement_type").alias("type"))
    return runs.override_union([a, b], "requirement_uid", "type").where("requirement_uid is not null")


@query("select requirement_uid, 'dataset only' as side from (select requirement_uid from label_dataset_v2 except select requirement_uid from split_assignment) union all select requirement_uid, 'both' from (select requirement_uid from label_dataset_v2 intersect select requirement_uid from split_assignment)")
def u2_set_difference(s, d):
    a, b = (table(s, d, t).select("requirement_uid") for t in ("label_dataset_v2", "split_assignment"))
    return a.subtract(b).withColumn("side", F.lit("dataset only")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


# --- windows, order, sampling ----------------------------------------------------------------------------------------


@query(f"""with {REC}, r as (select document_id, requirement_uid, coalesce(length(raw_requirement_text), 0) as l from rec), w as (select *, row_number() over (partition by document_id order by requirement_uid) as k, count(*) over (partition by document_id) as c, row_number() over (partition by document_id order by l desc, requirement_uid) as g from r)
select document_id, requirement_uid, 'first' as reason from w where k = 1 union all select document_id, requirement_uid, 'middle' from w where k = (c - 1) // 2 + 1 union all select document_id, requirement_uid, 'last' from w where k = c union all select document_id, requirement_uid, 'longest' from w where g = 1""")
def w1_edge_rows(s, d):
    return profile.edge_rows(records(s, d, "document_id", "raw_requirement_text"), "document_id", "requirement_uid", "raw_requirement_text")


@query(f"""with {REC}, r as (select requirement_uid, length(raw_requirement_text) as length from rec where raw_requirement_text is not null)
(select requirement_uid, length, 'shortest' as side, row_number() over (order by length, requirement_uid)::int as rank from r order by length, requirement_uid limit 5) union all (select requirement_uid, length, 'longest', row_number() over (order by length desc, requirement_uid desc)::int from r order by length desc, requirement_uid desc limit 5)""")
def o1_extremes(s, d):
    return profile.extremes(records(s, d, "raw_requirement_text"), "raw_requirement_text", "requirement_uid")


_QUOTA = {"1_기능": 3, "2_인프라": 2, "3_보안": 2, "4_데이터연계": 1, "5_관리품질제약": 2}


_RANK = {k: i for i, k in enumerate(_QUOTA)}
_case = lambda of: "case category " + " ".join(f"when '{k}' then {v}" for k, v in of.items()) + " else {} end".format(0 if of is _QUOTA else len(of))
SAMPLE = f"""r as (select requirement_uid, document_id, {_category_sql()} as category from rec), q as (select *, md5(requirement_uid) as h, row_number() over (partition by document_id, category order by md5(requirement_uid), requirement_uid) as k from r),
f as (select *, k <= {_case(_QUOTA)} as quota from q), smp as (select requirement_uid, document_id, category, case when quota then 'quota' else 'fill' end as stage from f qualify row_number() over (partition by document_id order by quota desc, case when quota then {_case(_RANK)} end, h, requirement_uid) <= 10)"""


def _sample(s, d):
    r = records(s, d, "document_id", "requirement_id").select("requirement_uid", "document_id", taxonomy.category(F.col("requirement_id")).alias("category"))
    return sampling.quota_sample(r, "document_id", "category", _QUOTA, 10, (F.md5("requirement_uid"), F.col("requirement_uid")))


@query(f"with {REC}, {SAMPLE} select requirement_uid, document_id, category, stage from smp")
def m1_stratified_sample(s, d):
    return _sample(s, d)


@query(f"""with {REC}, r as (select requirement_uid, {_display_sql()} as kind from rec), f as (select *, row_number() over (partition by kind order by requirement_uid) as turn, min(requirement_uid) over (partition by kind) as g from r)
select requirement_uid, kind, turn::int as turn from f order by turn, g limit 40""")
def w6_round_robin(s, d):
    r = records(s, d, "requirement_type").select("requirement_uid", taxonomy.display_type(F.col("requirement_type")).alias("kind"))
    return profile.round_robin(r, "kind", "requirement_uid", 40)


@query(f"with {REC} select requirement_type_normalized as value, count(*) as n, row_number() over (order by count(*) desc, requirement_type_normalized nulls first)::int as rank from rec group by 1")
def a18_ranked(s, d):
    return runs.ranked(records(s, d, "requirement_type_normalized").withColumnRenamed("requirement_type_normalized", "value"), "value")


# --- extraction ------------------------------------------------------------------------------------------------------

DOCS = "dd as (select distinct document_id, content from source_docs), td as (select document_id, unnest(regexp_extract_all(content, '<table><tr><td>요구사항 고유번호</td><td>([A-Z0-9-]+)</td></tr></table>', 1)) as requirement_id from dd)"


def _cells(s, d):
    return extract.parse_tables(table(s, d, "source_docs").select("document_id", "content").distinct(), "document_id", "content")


@query("""with c as (select distinct document_id, content from source_docs), t as (select document_id, unnest(regexp_extract_all(content, '<td>([^<]*)</td>', 1)) as text, generate_subscripts(regexp_extract_all(content, '<td>([^<]*)</td>', 1), 1) as i from c)
select document_id, count(*) as cells, string_agg(trim(regexp_replace(text, '[ \t]+', ' ', 'g')), '~' order by i) as texts from t group by 1""")
def t3_table_cells(s, d):
    c = _cells(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("cells"), F.array_sort(F.collect_list(F.struct("table", "row", "cell", "text"))).alias("x"))
    return c.select("document_id", "cells", F.array_join(F.transform("x", lambda x: x["text"]), "~").alias("texts"))


@query(f"with {DOCS} select document_id, requirement_id, 'labeled_id' as adapter, null::varchar as requirement_type, null::varchar as requirement_name, null::varchar as body, count(*) as n from td group by all")
def t10_requirements(s, d):
    return profile.counts(extract.requirements(_cells(s, d), "document_id"), "document_id", "requirement_id", "adapter", "requirement_type", "requirement_name", "body")


RECONCILED = f"""{REC}, {DOCS}, i as (select {DOC.format('document_id')} as doc, requirement_id as x, count(*) as ni from rec where requirement_id is not null group by all), e as (select {DOC.format('document_id')} as doc, requirement_id as x, count(*) as nd from td group by all),
j as (select coalesce(i.doc, e.doc) as doc, coalesce(i.x, e.x) as x, ni, nd from i full join e on i.doc = e.doc and i.x = e.x), df as (select doc, x, 'index_only' as reason from j where nd is null union all select doc, x, 'detail_only' from j where ni is null and doc in (select doc from i) union all select doc, x, 'duplicate_index' from j where ni > 1),
rc as (select doc, coalesce(sum(ni), 0)::bigint as index_count, coalesce(sum(nd), 0)::bigint as detail_count, (select count(*) from df where df.doc = j.doc and reason = 'index_only') as index_only, (select count(*) from df where df.doc = j.doc and reason = 'detail_only') as detail_only,
(select count(*) from df where df.doc = j.doc and reason = 'duplicate_index') as duplicate_index from j group by doc)"""


def _index_and_detail(s, d):
    """The identifiers of the label dataset, as the index, and those that stand in the documents."""
    i = records(s, d, "document_id", "requirement_id").where("requirement_id is not null").select(document_key(F.col("document_id")).alias("doc"), "requirement_id")
    return i, extract.requirements(_cells(s, d), "document_id").select(document_key(F.col("document_id")).alias("doc"), "requirement_id")


@query(f"with {RECONCILED} select *, index_count > 0 and index_only + detail_only + duplicate_index = 0 as exact from rc")
def a6_reconcile(s, d):
    return extract.reconcile(*_index_and_detail(s, d), "doc", "requirement_id")


@query(f"with {RECONCILED} select doc, x as requirement_id, reason from df")
def a6_differences(s, d):
    return extract.differences(*_index_and_detail(s, d), "doc", "requirement_id")


# --- retrieval -------------------------------------------------------------------------------------------------------


def _targets(s, d):
    a = table(s, d, "anchor_candidates_quote").groupBy("requirement_uid").agg(F.max(F.struct(F.coalesce("requirement_name", F.lit("")).alias("n"), F.coalesce("normalized_requirement_text", F.lit("")).alias("t"), "document_id")).alias("s"))
    return a.select(F.col("requirement_uid").alias("target"), F.col("s.document_id").alias("doc"), F.concat(F.col("s.n"), F.lit("\n"), F.col("s.t")).alias("text"))


def _pool(s, d):
    e = table(s, d, "eval_items")
    return e.select(F.col("item_id").cast("string").alias("anchor"), F.col("task").alias("doc"), F.col("expected_action").alias("label"), F.col("item_id").alias("pos"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "text").alias("text"))


_TGT = """tgt as (select requirement_uid as target, s.d as doc, s.n || chr(10) || s.t as text from (select requirement_uid, max(struct_pack(n := coalesce(requirement_name, ''), t := coalesce(normalized_requirement_text, ''), d := document_id)) as s from anchor_candidates_quote group by 1)),
pool as (select item_id::varchar as anchor, task as doc, expected_action as label, item_id as pos, coalesce(title, '') || chr(10) || text as text from eval_items)"""
_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


def _vec_sql(name: str, rel: str, k: str) -> str:
    space = f"trim(regexp_replace(lower(text), '[{SPACE_SQL}]+', ' ', 'g'), ' ')"
    grams = "list_concat([substring(p, i, 3) for i in generate_series(1, greatest(1, length(p) - 2))], case when length(p) > 3 then [substring(p, i, 4) for i in generate_series(1, greatest(1, length(p) - 3))] else [] end)"
    return f"""{name}_w as (select {k}, {_W} as w from {rel}), {name}_t as (
select {k}, 'word' as block, unnest(w) as term from {name}_w union all select {k}, 'word', unnest([w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)]) from {name}_w
union all select {k}, 'char', unnest({grams}) from (select {k}, ' ' || unnest(string_split({space}, ' ')) || ' ' as p from {rel} where {space} <> '')),
{name}_c as (select {k}, block, term, count(*) as tf from {name}_t group by all)"""


_SIM = f"""{_TGT}, {_vec_sql('p', 'pool', 'anchor')}, {_vec_sql('t', 'tgt', 'target')},
idf as (select block, term, ln((1.0 + (select count(*) from pool)) / (1.0 + count(*))) + 1.0 as idf from p_c group by all),
pr as (select anchor, block, term, (1 + ln(tf)) * idf as r from p_c join idf using (block, term)), tr as (select target, block, term, (1 + ln(tf)) * idf as r from t_c join idf using (block, term)),
pv as (select anchor, block, term, r / sqrt(sum(r * r) over (partition by anchor, block)) as v from pr), tv as (select target, block, term, r / sqrt(sum(r * r) over (partition by target, block)) as w from tr),
pb as (select anchor, count(distinct block) as b from pv group by 1), tb as (select target, count(distinct block) as b from tv group by 1),
sim as (select x.target, x.anchor, pool.label, pool.pos, dot / sqrt(tb.b * pb.b) as sim from (select target, anchor, sum(w * v) as dot from tv join pv using (block, term) group by all) x join tb using (target) join pb using (anchor) join tgt using (target) join pool using (anchor) where tgt.doc is distinct from pool.doc and dot > 0)"""


@query(f"with {_SIM} select target, anchor, rank::int as rank, round(sim, 6) as sim from (select *, row_number() over (partition by target order by sim desc, pos) as rank from sim) where rank <= 3")
def x5_top_anchors(s, d):
    return retrieval.retrieve(_targets(s, d), _pool(s, d), "similarity").select("target", "anchor", "rank", F.round("sim", 6).alias("sim"))


@query(f"with {_SIM}, k as (select *, row_number() over (partition by target, label order by sim desc, pos) as k, row_number() over (partition by target order by sim desc, pos) as top from sim), c as (select *, case when k = 1 and label in {rules.ACTIONS} then list_position({list(rules.ACTIONS)}, label) else 3 + top end as place from k where top <= 6 or k = 1 and label in {rules.ACTIONS}), r as (select *, row_number() over (partition by target order by place) as rank from c) select target, anchor, label, rank::int as rank from r where rank <= 3")
def x6_stratified_anchors(s, d):
    return retrieval.retrieve(_targets(s, d), _pool(s, d), "stratified", labels=rules.ACTIONS).select("target", "anchor", "label", "rank")


@query(f"with {_TGT} select target, min_by(anchor, pos) as anchor, label from tgt join pool on tgt.doc is distinct from pool.doc group by target, label")
def x7_global_anchors(s, d):
    return retrieval.retrieve(_targets(s, d), _pool(s, d), "global").select("target", "anchor", "label")


@query(f"""with {_TGT}, {_vec_sql('t', 'tgt', 'target')}, c as (select * from t_c where block = 'char'), idf as (select term, count(*) as df, ln((1.0 + (select count(*) from tgt)) / (1.0 + count(*))) + 1.0 as idf from c group by 1 having count(*) >= 2),
r as (select target, term, (1 + ln(tf)) * idf as r from c join idf using (term)), v as (select target, term, r / sqrt(sum(r * r) over (partition by target)) as w from r),
s as (select a.target as "left", b.target as "right", sum(a.w * b.w) as sim from v a join v b on a.term = b.term and a.target < b.target group by all)
select "left", "right", round(sim, 6) as sim from s join tgt x on x.target = "left" join tgt y on y.target = "right" where x.doc is distinct from y.doc and sim >= 0.6""")
def x12_cosine_pairs(s, d):
    rows = _targets(s, d).withColumnRenamed("target", "id")
    return retrieval.cosine_join(rows, 0.6).select("left", "right", F.round("sim", 6).alias("sim"))


#: Anchors of each action in the pool of the label dataset.
POOL_ROWS = 80


def _label_rows(s, d):
    """(id, doc, label, name, text): the latest state of every record of the label dataset that has a text; ``doc`` in one spelling, ``label`` as in rules.ACTIONS or NULL."""
    x = table(s, d, "label_dataset_v2").where("requirement_uid is not null")
    x = x.groupBy(F.col("requirement_uid").alias("id")).agg(F.max(F.struct("built_at", "document_id", "primary_action", "requirement_name", "raw_requirement_text")).alias("s"))
    label = canonical_label(F.col("s.primary_action"), rules.ACTIONS)
    return x.select("id", document_key(F.col("s.document_id")).alias("doc"), label.alias("label"), F.coalesce("s.requirement_name", F.lit("")).alias("name"), F.col("s.raw_requirement_text").alias("text")).where("text is not null")


def _label_targets(s, d):
    return _label_rows(s, d).select(F.col("id").alias("target"), "doc", F.concat("name", F.lit("\n"), "text").alias("text"))


def _label_pool(s, d):
    """A pool of fixed size with the records' own documents: POOL_ROWS records of each action, by hash."""
    w = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    x = _label_rows(s, d).where("label is not null and doc is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= POOL_ROWS)
    return x.select(F.col("id").alias("anchor"), "doc", "label", F.row_number().over(Window.orderBy("k", "label")).alias("pos"), F.concat("name", F.lit("\n"), "text").alias("text"))


@query()
def x5_label_anchors(s, d):
    """x5 for every record of the label dataset, with a pool whose documents are real."""
    return retrieval.retrieve(_label_targets(s, d), _label_pool(s, d), "similarity").select("target", "anchor", "rank", F.round("sim", 6).alias("sim"))


@query()
def x6_label_anchors(s, d):
    return retrieval.retrieve(_label_targets(s, d), _label_pool(s, d), "stratified", labels=rules.ACTIONS).select("target", "anchor", "label", "rank")


@query()
def x7_label_anchors(s, d):
    return retrieval.retrieve(_label_targets(s, d), _label_pool(s, d), "global").select("target", "anchor", "label")


@query()
def x12_label_pairs(s, d):
    """x12 over the whole label dataset: near pairs of different documents."""
    return retrieval.cosine_join(_label_rows(s, d).select("id", "doc", "text"), 0.6).select("left", "right", F.round("sim", 6).alias("sim"))


@query("""with q as (select vec_id as query, embedding as q from embeddings where vec_id % 100 = 0), s as (select query, vec_id as id, round(list_cosine_similarity(q::double[], embedding::double[]), 6) as sim from q join embeddings on query <> vec_id)
select query, id, row_number() over (partition by query order by sim desc, id)::int as rank from s qualify row_number() over (partition by query order by sim desc, id) <= 10""")
def z4_dense_top_k(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.dense_top_k(v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q")), v, 10)
