"""Further named queries over whole tables, each with its SQL: document build, assembly, pools, samples, comparisons, near-duplicate analysis, leftovers of the profile."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheafwork.functions.canon import document_key, label_key
from sheafwork.operators import assembly, build, compare, extract, pool, profile, retrieval, rules, runs, sampling, taxonomy
from sheafwork.plans.catalog import ANS, DOC, DOCS, KEY, KEYS, REC, RECONCILED, SAMPLE, SPACE_SQL, _category_sql, _display_sql, _index_and_detail, _map_sql, _sample, _targets, _TGT, _vec_sql, a14_majority_vote, answers, key, query, records
from sheafwork.session import table
from sheafwork.sources import readers

ACTION = KEY.format("primary_action")
ACTION_KEYS = ("통상수용", "견적반영", "계약질의검토")
MAJORITY = f"""mv as (select requirement_uid, struct_pack(t := received_at, a := annotator_id) as seen, {KEY.format('label.primary_action')} as action from ans), mc as (select requirement_uid, action, count(*) as n, min(seen) as f from mv group by all),
maj as (select requirement_uid, action from mc qualify row_number() over (partition by requirement_uid order by n desc, f) = 1)"""
LENGTH = "length(raw_requirement_text)"


def _length():
    return F.length("raw_requirement_text")


# --- sources and text ------------------------------------------------------------------------------------------------


@query("select run_name, count(*) filter (where status = 'ok') as ok, count(*) as total from results group by 1")
def s13_run_inventory(s, d):
    return readers.run_inventory(table(s, d, "results"))


@query(f"with {REC} select requirement_uid from rec order by requirement_uid limit 50 offset 100")
def s10_row_range(s, d):
    return readers.row_range(records(s, d, "document_id").select("requirement_uid"), "requirement_uid", 101, 50)


@query("with l as (select document_id, content, string_split(content, chr(10)) as ls from (select distinct document_id, content from source_docs)), h as (select document_id, generate_subscripts(ls, 1) as line, unnest(ls) as t from l), x as (select document_id, line, case when regexp_matches(t, '(?i)</?(tr|td|th)\\b') then '' else trim(trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g')), '#* |' || chr(9)) end as heading from h) select document_id, line::int as line, heading from x where heading <> ''")
def t4_headings(s, d):
    lines = table(s, d, "source_docs").select("document_id", "content").distinct().select("document_id", F.posexplode(F.split("content", "\n")).alias("line", "t"))
    return lines.select("document_id", (F.col("line") + 1).alias("line"), build.heading_text(F.col("t")).alias("heading")).where("heading <> ''")


@query()
def t5_index_ids(s, d):
    return build.index_ids(table(s, d, "source_docs").select("document_id", "content").distinct(), "document_id", "content")


@query("""with c as (select distinct file_name, document_id, agency, domain, content from source_docs), r as (select *, regexp_extract(content, '<table><tr><td>요구사항 고유번호</td><td>([A-Z0-9-]+)</td></tr></table>', 1) as rid, len(string_split(split_part(content, '<table>', 1), chr(10))) as line from c where contains(content, '<table>'))
select 'requirements_v2' as dataset_version, document_id, agency, domain, document_id || ':' || rid as requirement_uid, rid as requirement_id, rid as source_requirement_id, null::varchar as requirement_type, null::varchar as requirement_name, null::varchar as raw_requirement_text, null::varchar as normalized_requirement_text,
file_name as source_file, 'markdown_line:' || line as source_location, 1 as source_table_index, 1 as source_block_index, sha256(content) as source_sha256, 'labeled_id' as extraction_adapter from r where rid <> ''""")
def t12_document_records(s, d):
    docs = table(s, d, "source_docs").select("file_name", "document_id", "agency", "domain", "content").distinct()
    return build.records(docs, "requirements_v2")


@query("select distinct requirement_uid, document_id || ':' || requirement_id as made_uid, requirement_uid = document_id || ':' || requirement_id as same from anchor_candidates_quote")
def n15_made_uids(s, d):
    made = build.uid(F.col("document_id"), F.col("requirement_id"))
    return table(s, d, "anchor_candidates_quote").select("requirement_uid", made.alias("made_uid"), (F.col("requirement_uid") == made).alias("same")).distinct()


# --- projections -----------------------------------------------------------------------------------------------------


@query("select distinct requirement_uid, requirement_id, source_requirement_id from anchor_candidates_quote where requirement_id is distinct from source_requirement_id")
def t_id_mismatches(s, d):
    return build.id_mismatches(table(s, d, "anchor_candidates_quote")).select("requirement_uid", "requirement_id", "source_requirement_id").distinct()


@query("select coalesce(nullif(label.primary_action, ''), nullif(error_type, ''), nullif(status, '')) as first, count(*) as n from results group by 1")
def t_first_labels(s, d):
    return profile.counts(table(s, d, "results"), compare.first_label(F.col("label.primary_action"), F.col("error_type"), F.col("status")).alias("first"))


_PREFIX = "case when instr(requirement_id, '-') > 0 then trim(split_part(requirement_id, '-', 1)) else substring(requirement_id, 1, 3) end"


@query(f"with {REC} select coalesce({_map_sql(taxonomy.PREFIX_NAMES, _PREFIX)}, '{taxonomy.UNKNOWN}') as name, count(*) as n from rec group by 1")
def t_prefix_names(s, d):
    return profile.counts(records(s, d, "requirement_id"), taxonomy.prefix_name(F.col("requirement_id")).alias("name"))


@query(f"with {REC}, q as (select quantile_cont({LENGTH}, 0.95) as l from rec) select requirement_uid, {LENGTH} as value from rec, q where {LENGTH} >= l")
def t_p95_outliers(s, d):
    return profile.at_least_quantile(records(s, d, "raw_requirement_text"), _length(), 0.95).select("requirement_uid", "value")


@query(f"with {REC} select requirement_uid, len(blockers)::int as blocker_count, split_part(requirement_id, '-', 1) as category, {LENGTH}::int as text_length from rec")
def t_derived_columns(s, d):
    r = records(s, d, "blockers", "requirement_id", "raw_requirement_text")
    return r.select("requirement_uid", F.when(F.col("blockers").isNotNull(), F.size("blockers")).alias("blocker_count"), taxonomy.id_prefix(F.col("requirement_id")).alias("category"), _length().alias("text_length"))


@query(f"with {REC}, {ANS}, {MAJORITY} select requirement_uid, {ACTION} as before, m.action as after from rec join maj m using (requirement_uid) where {ACTION} is distinct from m.action")
def t_changed_verdicts(s, d):
    now = records(s, d, "primary_action").select("requirement_uid", key("primary_action").alias("action"))
    return compare.changed(now, a14_majority_vote(s, d), "requirement_uid", "action")


@query("""with {} select requirement_uid, annotator_id, generate_subscripts(anchors_used, 1)::int as position, unnest(anchors_used).requirement_uid as anchor, unnest(anchors_used).primary_action as primary_action, round(unnest(anchors_used).similarity, 4) as similarity, len(unnest(anchors_used).overlap_terms)::int as overlap
from (select * from results where status = 'ok' and label is not null qualify row_number() over (partition by requirement_uid, annotator_id order by received_at desc) = 1)""".replace("with {} ", ""))
def t_anchor_trace(s, d):
    r = table(s, d, "results").where("status = 'ok' and label is not null").groupBy("requirement_uid", "annotator_id").agg(F.max(F.struct("received_at", "anchors_used")).alias("x"))
    t = r.select("requirement_uid", "annotator_id", F.posexplode(compare.trace(F.col("x.anchors_used"), with_document=False)).alias("position", "a"))
    return t.select("requirement_uid", "annotator_id", (F.col("position") + 1).alias("position"), F.col("a.requirement_uid").alias("anchor"), "a.primary_action", "a.similarity", F.size("a.overlap_terms").alias("overlap"))


# --- assembly --------------------------------------------------------------------------------------------------------


def _union(s, d):
    """The results as runs, one per run name; the path is told by the name."""
    r = table(s, d, "results")
    return assembly.union_runs([("sync", "동기", r.where("strategy = 'zero-shot'")), ("batch", "배치", r.where("strategy <> 'zero-shot'"))])


@query("select case when strategy = 'zero-shot' then 'sync' else 'batch' end as source_run, case when strategy = 'zero-shot' then '동기' else '배치' end as execution_path, count(*) as n from results where status = 'ok' and strategy is not null group by all")
def u1_union_runs(s, d):
    return profile.counts(_union(s, d), "source_run", "execution_path")


@query("select requirement_uid, count(*) as n, array_to_string(list_sort(list(distinct case when strategy = 'zero-shot' then 'sync' else 'batch' end)), '|') as runs from results where status = 'ok' and strategy is not null group by 1 having count(*) > 1")
def v6_overlapping_runs(s, d):
    return assembly.overlapping(_union(s, d)).withColumn("runs", F.array_join("runs", "|"))


@query("select distinct requirement_uid from results where status = 'ok' and strategy is not null and requirement_uid not in (select requirement_uid from anchor_candidates_quote where requirement_uid is not null)")
def j1_unknown_requirements(s, d):
    return assembly.unknown(_union(s, d), table(s, d, "anchor_candidates_quote").where("requirement_uid is not null"))


_SPELL = r"nullif(replace(replace(regexp_replace(requirement_type, '\([A-Z]{2,4}\)', '', 'g'), ' ', ''), '요구사항', ''), '')"
ASSEMBLED = f"""{REC}, la as (select requirement_uid, label, run_name, strategy from results where status = 'ok' and label is not null qualify row_number() over (partition by requirement_uid order by received_at desc, annotator_id desc) = 1),
asm as (select requirement_uid, rec.document_id, {_map_sql(taxonomy.TEXT_TYPES, _SPELL)} as by_text, {_map_sql(taxonomy.PREFIX_TYPES, "split_part(requirement_id, '-', 1)")} as by_prefix,
case when coalesce({KEYS.format('label.blockers')}, '') <> '' then '계약·질의검토' when coalesce({KEY.format('label.cost_basis')}, '없음') <> '없음' then '견적반영' else '통상수용' end as primary_action, label.primary_action as primary_action_model, la.run_name as source_run,
case when strategy = 'zero-shot' then '동기' else '배치' end as execution_path from rec join la using (requirement_uid)),
ds as (select requirement_uid, document_id, coalesce(by_text, by_prefix, '{taxonomy.UNKNOWN}') as requirement_type_normalized, case when by_text is not null then 'text' when by_prefix is not null then 'prefix' else 'none' end as requirement_type_source, primary_action, primary_action_model, {KEY.format('primary_action')} is distinct from {KEY.format('primary_action_model')} as rule_corrected, execution_path, source_run from asm)"""


def _assembled(s, d):
    """The label dataset anew, from each requirement's latest answer."""
    last = table(s, d, "results").where("status = 'ok' and label is not null").groupBy("requirement_uid").agg(F.max(F.struct("received_at", "annotator_id", "label", "run_name", "strategy")).alias("x"))
    path = F.when(F.col("x.strategy") == "zero-shot", "동기").otherwise("배치")
    union = last.select("requirement_uid", "x.label", F.col("x.run_name").alias("source_run"), path.alias("execution_path"))
    return assembly.assemble(union, records(s, d, *assembly.REQUIREMENT_FIELDS), "v2")


@query(f"with {ASSEMBLED} select * from ds")
def k5_assembled_dataset(s, d):
    return _assembled(s, d).select("requirement_uid", "document_id", "requirement_type_normalized", "requirement_type_source", "primary_action", "primary_action_model", "rule_corrected", "execution_path", "source_run")


@query(f"with {ASSEMBLED} select requirement_uid, source_run, primary_action_model as model, primary_action as rule from ds where rule_corrected")
def t_corrections(s, d):
    return assembly.corrections(_assembled(s, d)).select("requirement_uid", "source_run", "model", "rule")


@query(f"""with {ASSEMBLED} select 'source_run' as "column", source_run as value, count(*) as n from ds group by all union all select 'execution_path', execution_path, count(*) from ds group by all union all select 'requirement_type_normalized', requirement_type_normalized, count(*) from ds group by all
union all select 'requirement_type_source', requirement_type_source, count(*) from ds group by all union all select 'primary_action', primary_action, count(*) from ds group by all""")
def k5_manifest_counts(s, d):
    return assembly.manifest_counts(_assembled(s, d))


@query()
def k5_content_hash(s, d):
    return assembly.content_hash(_assembled(s, d))


def _audit_sql() -> str:
    empty = [(f"empty {c}", f"count(*) filter (where coalesce(trim({c}), '') = '')") for c in rules.REQUIRED]
    bad = [(f"domain {c}", f"count(*) filter (where {c} not in {v})") for c, v in rules.DOMAINS.items()]
    bad.append(("domain blockers", f"count(*) filter (where blockers is null or len(list_filter(blockers, lambda x: x is null or x not in {rules.BLOCKERS})) > 0)"))
    bad.append(("schema_version", "count(*) filter (where schema_version is distinct from 'v2')"))
    parts = [f"select {i + 1} as place, '{name}' as rule, {e} as n from rec" for i, (name, e) in enumerate(empty + bad)]
    return f"with {REC} select 0 as place, 'repeated requirement_uid' as rule, 0::bigint as n union all " + " union all ".join(parts)


@query(_audit_sql())
def v3_dataset_audit(s, d):
    return rules.audit_counts(records(s, d, *rules.REQUIRED[1:], "blockers"), "v2")


@query(f"""with r as (select * from label_dataset_v2) select 'repeated key' as "check", count(*) - count(distinct requirement_uid) as n from r union all select 'empty body', count(*) filter (where coalesce(raw_requirement_text, '') = '') from r union all select 'missing type', count(*) filter (where coalesce(requirement_type, '') = '') from r""")
def a38_integrity(s, d):
    return profile.integrity(table(s, d, "label_dataset_v2"), "requirement_uid", "raw_requirement_text", "requirement_type")


# --- document build over the tables ----------------------------------------------------------------------------------

_ANCHORS = "an as (select * from anchor_candidates_quote where requirement_uid is not null qualify row_number() over (partition by requirement_uid order by source_table_index, source_block_index) = 1)"


def _anchor_records(s, d):
    a = table(s, d, "anchor_candidates_quote").where("requirement_uid is not null")
    w = Window.partitionBy("requirement_uid").orderBy("source_table_index", "source_block_index")
    return a.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _judged(s, d):
    """The differences of index and documents; a document's repeated index entries are accepted, also where they are in the index only."""
    both = extract.differences(*_index_and_detail(s, d), "doc", "requirement_id").withColumnRenamed("doc", "document_id")
    twice = both.where("reason = 'duplicate_index'").select("document_id", "requirement_id")
    accepted = twice.withColumn("reason", F.explode(F.array(F.lit("duplicate_index"), F.lit("index_only"))))
    return extract.apply_policy(both, accepted, "document_id", "requirement_id")


@query(f"with {RECONCILED} select doc as document_id, x as requirement_id, reason, reason = 'duplicate_index' or reason = 'index_only' and (doc, x) in (select (doc, x) from df where reason = 'duplicate_index') as accepted from df")
def a7_policy(s, d):
    return _judged(s, d)


@query(f"""with {RECONCILED}, {_ANCHORS}, one as (select count(*) as record_count, count(distinct document_id) as document_count, count(*) filter (where coalesce(requirement_name, '') = '') as missing_name_count, count(*) filter (where coalesce(raw_requirement_text, '') = '') as missing_body_count from an),
c as (select *, index_count > 0 and index_only + detail_only + duplicate_index = 0 as exact, doc not in (select doc from df a where reason <> 'duplicate_index' and not (reason = 'index_only' and (doc, x) in (select (doc, x) from df where reason = 'duplicate_index'))) as resolved from rc)
select one.*, 0::bigint as duplicate_uid_count, (select count(*) from (select distinct document_id from source_docs where document_id is not null) x where document_id not in (select document_id from an where document_id is not null)) as empty_document_count,
(select count(*) from c where exact) as index_exact_match_document_count, (select count(*) from c where index_count > 0 and not exact) as index_mismatch_document_count, (select count(*) from c where index_count > 0 and not exact and resolved) as index_policy_resolved_document_count,
(select count(*) from c where index_count > 0 and not resolved) as unresolved_index_mismatch_document_count, (select count(*) from c where index_count = 0) as document_without_index_count from one""")
def a8_audit(s, d):
    compared = extract.reconcile(*_index_and_detail(s, d), "doc", "requirement_id").withColumnRenamed("doc", "document_id")
    return build.audit(_anchor_records(s, d), table(s, d, "source_docs").where("document_id is not null"), extract.resolve(compared, _judged(s, d), "document_id"))


@query(f"""with {RECONCILED} select reason, count(*) as n from df group by 1 union all select unnest(['document_first', 'document_middle', 'document_last', 'document_longest']), count(distinct document_id) from anchor_candidates_quote where requirement_uid is not null""")
def j2_review_queue(s, d):
    queue = build.review_queue(_anchor_records(s, d), _judged(s, d))
    return profile.counts(queue, "reason")


@query(f"""with {_ANCHORS}, f as (select file_name, min(agency) as agency, min(domain) as domain from source_docs group by 1) select requirement_uid, source_file, f.agency, f.domain from an join f on f.file_name = an.source_file""")
def j11_file_metadata(s, d):
    f = table(s, d, "source_docs").groupBy(F.col("file_name").alias("source_file")).agg(F.min("agency").alias("agency"), F.min("domain").alias("domain"))
    return _anchor_records(s, d).select("requirement_uid", "source_file").join(f, "source_file")


# --- pools and samples -----------------------------------------------------------------------------------------------


@query(f"with {REC}, dom as (select unnest({list(rules.ACTIONS)}) as action), g as (select primary_action as action, count(*) as n, count(distinct document_id) as documents from rec group by 1) select dom.action, coalesce(n, 0) as n, coalesce(documents, 0) as documents, coalesce(n, 0) = 0 as missing from dom left join g using (action)")
def a9_pool_metadata(s, d):
    return pool.metadata(records(s, d, "primary_action", "document_id"))


@query(f"""with {REC}, t as (select distinct requirement_uid from split_assignment where split = 'test') select 'v1' as pool_version, count(*) as n from rec where requirement_uid in (select requirement_uid from t) union all select 'v2', count(*) from rec where source_run is distinct from (select min(source_run) from rec) union all select 'v3', count(*) from rec""")
def t_pool_versions(s, d):
    r = records(s, d, "source_run")
    late = r.agg(F.min("source_run")).first()[0]
    return profile.counts(pool.versions(r, table(s, d, "split_assignment").where("split = 'test'"), late), "pool_version")


@query()
def m2_pilot_sample(s, d):
    a = _anchor_records(s, d)
    return sampling.pilot_sample(a, taxonomy.display_type(F.col("requirement_type")))


@query()
def m3_bullets_first(s, d):
    return sampling.bullets_first(records(s, d, "document_id", "raw_requirement_text"), 3).select("document_id", "requirement_uid", "has_bullet", "rank")


@query(f"with {REC} select requirement_uid, {LENGTH}::int as length from rec order by coalesce({LENGTH}, 0) desc, requirement_uid desc limit 1")
def m4_longest(s, d):
    return sampling.longest(records(s, d, "raw_requirement_text")).select("requirement_uid", _length().alias("length"))


@query(f"""with {_ANCHORS}, f as (select file_name, max(length(content)) as size from source_docs group by 1), b as (select file_name from f where file_name in (select source_file from an) order by size desc, file_name desc limit 1) select requirement_uid, source_file from an where source_file = (select file_name from b)""")
def m4_largest_document(s, d):
    files = table(s, d, "source_docs").groupBy("file_name").agg(F.max(F.length("content")).alias("size"))
    return sampling.of_largest_document(_anchor_records(s, d).select("requirement_uid", "source_file"), files)


@query(f"with {REC}, {SAMPLE} select document_id, category, 0 as overall, count(*) as n from smp group by all union all select null, category, 1, count(*) from smp group by all")
def a44_sample_composition(s, d):
    return compare.composition(_sample(s, d), "document_id", "category")


# --- comparisons -----------------------------------------------------------------------------------------------------


@query(f"with {ANS}, v as (select requirement_uid, {KEY.format('label.primary_action')} as action from ans), g as (select requirement_uid, count(*) as n, min(coalesce(action, '')) as lo, max(coalesce(action, '')) as hi from v group by 1 having count(*) = 3) select requirement_uid, n, lo = hi as unanimous, case when lo = hi then lo end as action from g")
def a12_screening(s, d):
    return compare.screened(answers(s, d).withColumn("a", F.col("label.primary_action")).withColumn("action", key("a")), "requirement_uid", "action")


@query(f"with {ANS}, v as (select requirement_uid, {KEY.format('label.primary_action')} as action from ans), g as (select requirement_uid, min(coalesce(action, '')) as lo, max(coalesce(action, '')) as hi from v group by 1 having count(*) = 3) select lo as action, count(*) as n from g where lo = hi group by 1")
def m5_admitted(s, d):
    return profile.counts(compare.admitted(a12_screening(s, d)), "action")


@query(f"with {REC}, {ANS}, {MAJORITY} select requirement_uid, {ACTION} as gold, m.action, {ACTION} is not distinct from m.action as agrees from rec join maj m using (requirement_uid)")
def j12_gold(s, d):
    votes = a14_majority_vote(s, d).select("requirement_uid", "action")
    gold = records(s, d, "primary_action").select("requirement_uid", key("primary_action").alias("action")).join(votes.select("requirement_uid"), "requirement_uid", "left_semi")
    return compare.against_gold(gold, votes, "requirement_uid", "action")


@query(f"with {REC}, {ANS}, {MAJORITY}, dom as (select unnest([0, 1, 2])::int as place, unnest({list(ACTION_KEYS)}) as action), a as (select {ACTION} as action, count(*) as n from rec group by 1), b as (select action, count(*) as n from maj group by 1) select place, dom.action, coalesce(a.n, 0) as dataset, coalesce(b.n, 0) as votes, coalesce(b.n, 0) - coalesce(a.n, 0) as difference from dom left join a using (action) left join b using (action)")
def a43_side_by_side(s, d):
    now = records(s, d, "primary_action").select(key("primary_action").alias("action"))
    return compare.side_by_side(now, a14_majority_vote(s, d).select("action"), "action", ACTION_KEYS, ("dataset", "votes"))


@query(f"with {REC}, {ANS}, {MAJORITY}, a as (select requirement_uid, {ACTION} as x from rec), j as (select coalesce(m.action, a.x) as action from a full join maj m using (requirement_uid)), u as (select x as action from a union all select action from maj), g as (select action, count(*) as merged from j group by 1), h as (select action, count(*) as summed from u group by 1) select action, coalesce(merged, 0) as merged, coalesce(summed, 0) as summed from g full join h using (action)")
def u4_unique_and_sum(s, d):
    now = records(s, d, "primary_action").select("requirement_uid", key("primary_action").alias("action"))
    return compare.merged_counts(now, a14_majority_vote(s, d).select("requirement_uid", "action"), "requirement_uid", "action")


@query(f"with {REC}, {ANS}, v as (select requirement_uid, {KEY.format('label.primary_action')} as action from ans) select {_PREFIX} as prefix, action, count(*) as n from v join rec using (requirement_uid) group by all")
def j10_labels_by_prefix(s, d):
    votes = answers(s, d).withColumn("a", F.col("label.primary_action")).select("requirement_uid", key("a").alias("action"))
    return profile.counts(votes.join(records(s, d, "requirement_id"), "requirement_uid").select(taxonomy.short_prefix(F.col("requirement_id")).alias("prefix"), "action"), "prefix", "action")


_USES = "us as (select a.requirement_uid as requirement_uid, count(*) as uses from (select unnest(anchors_used) as a from results) group by 1)"


@query(f"with {REC}, {_USES} select t.requirement_uid, uses, document_id, {ACTION} as action from (select * from us order by uses desc, requirement_uid limit 10) t left join rec using (requirement_uid)")
def j13_top_anchors(s, d):
    r = records(s, d, "document_id", "primary_action").select("requirement_uid", "document_id", key("primary_action").alias("action"))
    return compare.best_attributes(runs.anchor_usage(table(s, d, "results")).select("requirement_uid", "uses"), r, "requirement_uid")


@query(f"with {REC}, {_USES}, j as (select coalesce(uses, 0) as uses from rec left join us using (requirement_uid)) select count(*) as anchors, count(*) filter (where uses > 0) as used, count(*) filter (where uses = 0) as unused, max(uses) as most, quantile_cont(uses, 0.5) as median from j")
def a31_usage_profile(s, d):
    return compare.usage_profile(runs.anchor_usage(table(s, d, "results")), records(s, d, "document_id"), "requirement_uid")


@query("with a as (select unnest(anchors_used).requirement_uid as anchor from results), g as (select anchor, count(*) as n from a group by 1) select n, count(*) as keys from g group by 1")
def a31_count_of_counts(s, d):
    return compare.count_of_counts(table(s, d, "results").select(F.explode("anchors_used").alias("a")).select("a.requirement_uid"), "requirement_uid")


@query(f"""with t as (select distinct requirement_uid as target from results where requirement_uid is not null), x as (select requirement_uid as target, unnest(anchors_used) as a from results where requirement_uid is not null), r as (select target, {KEY.format('a.primary_action')} as label from x), p as (select t.target, count(r.target) as k from t left join r using (target) group by 1)
select 'anchors' as what, k::varchar as item, count(*) as n from p group by k union all select 'label', label, count(*) from r group by label union all select 'empty', 'targets', count(*) filter (where k = 0) from p""")
def a32_preview(s, d):
    r = table(s, d, "results").where("requirement_uid is not null")
    shown = r.select(F.col("requirement_uid").alias("target"), F.explode("anchors_used").alias("a")).select("target", label_key(F.col("a.primary_action")).alias("label"))
    return compare.preview(r.select(F.col("requirement_uid").alias("target")).distinct(), shown)


@query("""select requirement_uid, annotator_id, coalesce(usage.input_tokens, 0) as input_tokens, coalesce(usage.output_tokens, 0) as output_tokens, coalesce(usage.cache_creation_input_tokens, 0) as cache_creation_input_tokens, coalesce(usage.cache_read_input_tokens, 0) as cache_read_input_tokens from results""")
def l5_usage_columns(s, d):
    return table(s, d, "results").select("requirement_uid", "annotator_id", *runs.usage_columns(F.col("usage")).values())


# --- profile leftovers -----------------------------------------------------------------------------------------------


@query(f"with {REC}, v as (select {LENGTH} as v from rec) select count(v) as n, avg(v) as mean, round(stddev_samp(v), 6) as std, min(v)::int as least, quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.9) as p90, quantile_cont(v, 0.95) as p95, max(v)::int as most from v")
def a22_describe(s, d):
    return profile.describe(records(s, d, "raw_requirement_text"), _length()).withColumn("std", F.round("std", 6))


@query(f"with {REC}, g as (select document_id, count({LENGTH}) as n, quantile_cont({LENGTH}, 0.25) as q1, quantile_cont({LENGTH}, 0.5) as median, quantile_cont({LENGTH}, 0.75) as q3 from rec group by 1) select *, row_number() over (order by median nulls first, document_id)::int as place from g")
def a41_quartiles(s, d):
    return profile.quartiles(records(s, d, "document_id", "raw_requirement_text"), _length(), "document_id")


@query(f"with {REC}, g as (select document_id, count(*) as n from rec group by 1) select count(*) as groups, sum(n)::bigint as rows, min(n) as least, max(n) as most, max(n) / sum(n) as most_share from g")
def a39_concentration(s, d):
    return compare.concentration(records(s, d, "document_id"), "document_id")


@query(f"with {REC}, t as (select distinct requirement_uid from split_assignment where split = 'test'), q as (select unnest([0.5, 0.9, 0.95])::double as quantile, unnest(quantile_cont({LENGTH}, [0.5, 0.9, 0.95])) as population from rec), w as (select unnest([0.5, 0.9, 0.95])::double as quantile, unnest(quantile_cont({LENGTH}, [0.5, 0.9, 0.95])) as sample from rec where requirement_uid in (select requirement_uid from t)) select * from q join w using (quantile)")
def a35_quantile_comparison(s, d):
    r = records(s, d, "raw_requirement_text")
    test = r.join(table(s, d, "split_assignment").where("split = 'test'").select("requirement_uid").distinct(), "requirement_uid", "left_semi")
    return profile.quantile_comparison(r, test, _length())


@query(f"with {REC}, b as (select unnest(list_distinct(list_transform(blockers, lambda b: {KEY.format('b')}))) as item from rec) select item, count(*) as n from b where item is not null group by 1")
def a26_item_counts(s, d):
    r = records(s, d, "blockers").select(F.transform("blockers", lambda b: F.regexp_replace(F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), b, F.lit(False)), "[^가-힣A-Za-z0-9]", "")).alias("blockers"))
    return profile.item_counts(r, "blockers").where("item is not null")


@query(f"with {REC} select {ACTION} as action, least(floor({LENGTH} / 100.0), 59)::int as bin, count(*) as n from rec where {LENGTH} between 0 and 6000 group by all")
def a40_histogram_by_label(s, d):
    r = records(s, d, "raw_requirement_text", "primary_action").select(key("primary_action").alias("action"), _length().alias("length"))
    return profile.histogram(r, "length", 0.0, 6000.0, 60, by=("action",))


@query(f"with {REC} select {_display_sql()} as kind, count(*) as n from rec group by 1 order by n desc, kind limit 15")
def o7_top_types(s, d):
    return profile.counts(records(s, d, "requirement_type"), taxonomy.display_type(F.col("requirement_type")).alias("kind")).orderBy(F.desc("n"), "kind").limit(15)


@query(f"with {REC} select requirement_uid from rec where contains(raw_requirement_text, ' | ') order by requirement_uid limit 10")
def o8_first_nested(s, d):
    return readers.head(records(s, d, "raw_requirement_text").where(F.col("raw_requirement_text").contains(" | ")).select("requirement_uid"), "requirement_uid", 10)


@query(f"with {REC}, l as (select {DOC.format('document_id')} as doc, {LENGTH} as v from rec) select doc, count(*) as n, sum(v)::bigint as chars from l group by 1")
def t_by_canonical_document(s, d):
    r = records(s, d, "document_id", "raw_requirement_text").select(document_key(F.col("document_id")).alias("doc"), _length().alias("v"))
    return r.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("chars"))


# --- near-duplicate analysis over the cosine pairs -------------------------------------------------------------------


def _pairs_sql(least: float) -> str:
    return f"""{_TGT}, {_vec_sql('t', 'tgt', 'target')}, c as (select * from t_c where block = 'char'), idf as (select term, ln((1.0 + (select count(*) from tgt)) / (1.0 + count(*))) + 1.0 as idf from c group by 1 having count(*) >= 2),
r as (select target, term, (1 + ln(tf)) * idf as r from c join idf using (term)), v as (select target, term, r / sqrt(sum(r * r) over (partition by target)) as w from r),
s as (select a.target as l, b.target as r, round(sum(a.w * b.w), 6) as sim from v a join v b on a.term = b.term and a.target < b.target group by all),
pairs as (select l, r, sim from s join tgt x on x.target = l join tgt y on y.target = r where x.doc is distinct from y.doc and sim >= {least}), both_ways as (select l as id, r as other, sim from pairs union all select r, l, sim from pairs),
near as (select id, other, sim from both_ways qualify row_number() over (partition by id order by sim desc, other) = 1)"""


def _near_rows(s, d):
    return _targets(s, d).withColumnRenamed("target", "id")


def _pairs(s, d, least: float = 0.5):
    return retrieval.cosine_join(_near_rows(s, d), least - 1e-6).withColumn("sim", F.round("sim", 6)).where(F.col("sim") >= least)


@query(f"with {_pairs_sql(0.5)}, t as (select unnest([0.9, 0.8, 0.6, 0.5])::double as threshold) select threshold, (select count(*) from near where sim >= threshold) as rows, (select count(*) from near where sim >= threshold) / (select count(*) from tgt) as share from t")
def a28_threshold_sweep(s, d):
    return retrieval.swept(_pairs(s, d), _near_rows(s, d))


@query(f"with {_pairs_sql(0.5)} select id, other, sim from near")
def w8_nearest_neighbour(s, d):
    return retrieval.nearest(_pairs(s, d))


@query(f"with {_pairs_sql(0.5)}, lab as (select requirement_uid as id, min(requirement_type) as label from anchor_candidates_quote group by 1) select count(*) as pairs, avg(case when a.label is not distinct from b.label then 1.0 else 0.0 end) as agree from pairs join lab a on a.id = l join lab b on b.id = r")
def a29_pair_agreement(s, d):
    labels = table(s, d, "anchor_candidates_quote").groupBy(F.col("requirement_uid").alias("id")).agg(F.min("requirement_type").alias("label"))
    return retrieval.label_agreement(_pairs(s, d), labels)


@query(f"with {_pairs_sql(0.5)} select doc, count(*) as rows, count(*) filter (where target in (select id from near)) as exposed, count(*) filter (where target in (select id from near)) / count(*) as share from tgt group by 1")
def a30_exposure(s, d):
    return retrieval.exposure(_pairs(s, d), _near_rows(s, d), "doc")


@query(f"""with {_pairs_sql(0.5)} select l as "left", r as "right", sim from pairs order by sim desc, l, r limit 20""")
def o9_most_similar(s, d):
    return retrieval.most_similar(_pairs(s, d), 20)


def _grams_sql() -> str:
    space = f"trim(regexp_replace(lower(text), '[{SPACE_SQL}]+', ' ', 'g'), ' ')"
    more = "".join(f", case when length(p) > {n - 1} then [substring(p, i, {n}) for i in generate_series(1, greatest(1, length(p) - {n - 1}))] else [] end" for n in (4, 5))
    return f"""{_TGT}, g as (select target, unnest(list_concat([substring(p, i, 3) for i in generate_series(1, greatest(1, length(p) - 2))]{more})) as term from (select target, ' ' || unnest(string_split({space}, ' ')) || ' ' as p from tgt where {space} <> '')), gc as (select target, term, count(*) as tf from g group by all)"""


@query(f"with {_grams_sql()} select term, count(*) as df, sum(tf)::bigint as tf from gc group by 1 having count(*) >= 2 order by tf desc, term limit 30000")
def x11_vocabulary(s, d):
    return retrieval.corpus_terms(_near_rows(s, d))


@query()
def x8_overlap_terms(s, d):
    """The shared terms of each target's best anchors."""
    from sheafwork.plans.catalog import _pool

    t, p = _targets(s, d), _pool(s, d)
    best = retrieval.retrieve(t, p, "similarity", 1).select("target", "anchor")
    return retrieval.overlap_terms(t, p, best).withColumn("terms", F.array_join("terms", ", "))
