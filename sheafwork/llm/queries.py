"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.llm import consensus, cross_split, grouped_split, leakage, mixing, near_dup, page_spam, quota_sample, splitting, value_mapping
from sheafwork.session import table


def queries() -> dict:
    q = {}

    def on(*names):
        def add(f):
            q[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])
            return f

        return add

    labels, anchors, split, docs = "label_dataset_v2", "anchor_candidates_quote", "split_assignment", "documents"

    @on(labels, "type_catalog")
    def p1_found(x, catalog):
        return value_mapping.mapped_requirements(x, catalog)

    @on(labels)
    def p2_found(x):
        return splitting.split_kinds(x)

    @on(labels)
    def p2_pieces(x):
        return splitting.split_texts(x)

    @on(labels)
    def p2_rejoined(x):
        return splitting.rejoined(x)

    @on(labels, "source_docs")
    def p3_found(x, d):
        return grouped_split.same_procurement(x, d)

    @on(labels, "source_docs")
    def p3_split(x, d):
        return grouped_split.grouped_split(x, d)

    @on(labels, "source_docs")
    def p3_together(x, d):
        return grouped_split.kept_together(x, d)

    @on(labels, "sample_targets")
    def p4_found(x, t):
        return quota_sample.shortfalls(x, t)

    @on(labels, "sample_targets")
    def p4_sample(x, t):
        return quota_sample.draw(x, t)

    @on(labels, "sample_targets")
    def p4_report(x, t):
        return quota_sample.report(x, t)

    @on(labels, split)
    def p5_found(x, s):
        return cross_split.overlapping_pairs(x, s)

    @on(labels, split)
    def p5_classes(x, s):
        return cross_split.overlap_classes(x, s)

    @on(labels, split)
    def p5_report(x, s):
        return cross_split.overlap_report(x, s)

    @on(labels, anchors)
    def p6_found(x, a):
        return near_dup.near_duplicate_requirements(x, a)

    @on(labels, anchors)
    def p6_groups(x, a):
        return near_dup.groups(near_dup.collection(x, a))

    @on("results", labels)
    def p7_found(r, x):
        return consensus.disputed(r, x)

    @on("results")
    def p7_consensus(r):
        return consensus.consensus(r)[0].withColumns({c: F.round(c, 6) for c in ("agreement", "confidence")})

    @on("results")
    def p7_reliability(r):
        return consensus.consensus(r)[1].select("annotator_id", "field", F.round("competence", 6).alias("competence"))

    @on(docs, "eval_items")
    def p8_found(d, e):
        return leakage.leaked_items(d, e)

    @on(docs, "eval_items")
    def p8_leaks(d, e):
        return leakage.leaks(d, e)

    @on(docs, "source_weights")
    def p9_found(d, w):
        return mixing.short_sources(d, w)

    @on(docs, "source_weights")
    def p9_mix(d, w):
        return mixing.mix(d, w, mixing.ramped(w))

    @on(docs, "source_weights")
    def p9_report(d, w):
        return mixing.mix_report(d, w).select("source", "target_share", "max_repeats", "tokens", "mixed_tokens", F.round("actual_share", 9).alias("actual_share"), "short")

    @on(docs)
    def p10_found(d):
        return page_spam.spam_pages(d)

    return q


def _doc(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '\\.md$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _label(c: str) -> str:
    return f"regexp_replace(nfc_normalize({c}), '[^가-힣A-Za-z0-9]', '', 'g')"


def _words(c: str) -> str:
    """SQL of a text's words. NFKC is spelled out as far as a database without it can: canonical composition and the full-width forms of ASCII."""
    wide, plain = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    return f"regexp_extract_all(lower(nfc_normalize(translate(regexp_replace({c}, '[\u200b\u200c\u200d\ufeff\u00ad]', '', 'g'), '{wide}', '{plain}'))), '[\\p{{L}}\\p{{N}}]+')"


#: SQL of the pairs (a, b), a < b, of one collection ``col`` (u, t) whose word overlap reaches 0.7, from ten words on.
_OVERLAPS = f"""w as (select distinct u, {_words('t')} as ws from col where u is not null and t is not null), d as (select u, unnest(list_distinct(ws)) as x from w where len(ws) >= 10), n as (select u, count(*) as c from d group by 1),
k as (select a.u as a, b.u as b, count(*) as m from d a join d b on a.x = b.x and a.u < b.u group by all), pairs as (select a, b from k join n na on na.u = a join n nb on nb.u = b where m / (na.c + nb.c - m) >= 0.7)"""


def oracle_sql() -> dict[str, str]:
    """Plain SQL on whole tables. The other operators are tested against brute force, round trips and known truth in tests/llm."""
    return {
        "p2_found": """select distinct requirement_uid, case when list_max(list_transform(regexp_split_to_array(raw_requirement_text, '[ \t\r\n]+'), lambda x: length(x))) > 1500 then 'forced' else 'natural' end as kind
from label_dataset_v2 where length(raw_requirement_text) > 1500 and requirement_uid is not null""",
        "p3_found": f"""with recursive d as (select {_doc('document_id')} as doc, {_doc('supersedes_document_id')} as old, lower(trim(source_sha256)) as sha, left(regexp_replace(notice_no, '[^0-9]', '', 'g'), 11) as notice from source_docs),
e as (select doc as u, 'd:' || old as v from d where old <> '' union select doc, 'h:' || sha from d where length(sha) = 64 union select doc, 'n:' || notice from d where length(notice) = 11),
n as (select 'd:' || u as u, v from e union select v, 'd:' || u from e), s as (select distinct document_id, 'd:' || {_doc('document_id')} as k from label_dataset_v2 where document_id is not null),
r as (select k as a, k as b from s union select r.a, n.v from r join n on r.b = n.u)
select x.document_id as document_id_a, y.document_id as document_id_b from (select distinct a, b from r) p join s x on x.k = p.a join s y on y.k = p.b where x.document_id < y.document_id""",
        "p2_rejoined": "select distinct requirement_uid, md5(raw_requirement_text) as text_md5 from label_dataset_v2 where length(raw_requirement_text) > 1500 and requirement_uid is not null",
        "p3_together": "select count(distinct requirement_uid) as records, 0::bigint as torn, true as balanced from label_dataset_v2 where requirement_uid is not null",
        "p5_found": f"""with col as (select requirement_uid as u, raw_requirement_text as t from label_dataset_v2), {_OVERLAPS}, sp as (select distinct requirement_uid as u, lower(trim(split)) = 'train' as train from split_assignment where lower(trim(split)) in ('train', 'validation', 'test'))
select distinct a as requirement_uid_a, b as requirement_uid_b from pairs join sp x on x.u = a join sp y on y.u = b where x.train <> y.train""",
        "p6_found": f"""with col as (select requirement_uid as u, raw_requirement_text as t from label_dataset_v2 union all select requirement_uid, normalized_requirement_text from anchor_candidates_quote), {_OVERLAPS} select distinct a as requirement_uid_a, b as requirement_uid_b from pairs""",
        "p8_found": f"""with i as (select distinct item_id, {_words('text')} as w from eval_items where text is not null), d as (select distinct doc_id, {_words('text')} as w from documents where text is not null),
gi as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(generate_series(1, len(w) - 11)) as k from i)), gd as (select distinct doc_id, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) as k from d))
select distinct doc_id, item_id from gd join gi using (g)""",
        # the answer doesn't hang on the tokenizer, so bytes stand for tokens
        "p9_found": r"""with d as (select nullif(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '') as k, coalesce(strlen(text), 0) as n from documents), b as (select sum(n) as n from d where k is not null), c as (select k, sum(n) as n from d where k is not null group by 1)
select distinct source from source_weights w left join c on c.k = lower(regexp_replace(w.source, '^\s+|\s+$', '', 'g')), b where coalesce(c.n, 0) * coalesce(max_repeats, 1) < target_share * b.n""",
        "p4_found": f"""with rec as (select * from label_dataset_v2 where requirement_uid is not null qualify row_number() over (partition by requirement_uid order by built_at desc) = 1),
c as (select {_doc('document_id')} as d, {_label('primary_action')} as a, count(*) as n from rec group by all)
select distinct t.document_id, t.primary_action from sample_targets t left join c on c.d = {_doc('t.document_id')} and c.a = {_label('t.primary_action')}
where coalesce(c.n, 0) < greatest(coalesce(t.min_rows, 0), floor(t.sample_size * t.target_share + 0.5))""",
    }
