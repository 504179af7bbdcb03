"""Requirement types: ordered rules, canonical types by text then prefix, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical type of each normalised spelling.
TEXT_TYPES = {
    "기능": "기능", "그룹웨어기능": "기능", "AI활용업무기능": "기능", "AI기반솔루션": "기능", "ECM": "기능", "서비스": "기능", "성능": "성능",
    "시스템장비구성": "시스템장비구성", "시스템장비": "시스템장비구성", "시스템": "시스템장비구성", "시스템구성": "시스템장비구성", "AI플랫폼및인프라": "시스템장비구성", "인프라": "시스템장비구성", "인프라상세": "시스템장비구성",
    "인터페이스": "인터페이스", "데이터": "데이터", "테스트": "테스트", "보안": "보안", "프로젝트보안": "보안", "품질": "품질", "품질관리": "품질", "제약사항": "제약사항", "안전": "제약사항",
    "프로젝트관리": "프로젝트관리", "거버넌스및PMO": "프로젝트관리", "프로젝트지원": "프로젝트지원", "컨설팅": "컨설팅",
}
# Canonical type of each identifier prefix.
PREFIX_TYPES = {
    "SFR": "기능", "FUN": "기능", "PER": "성능", "ECR": "시스템장비구성", "SYS": "시스템장비구성", "INF": "시스템장비구성", "INR": "인터페이스", "SIR": "인터페이스", "INT": "인터페이스", "DAR": "데이터", "DAT": "데이터",
    "TER": "테스트", "TST": "테스트", "SER": "보안", "SEC": "보안", "QUR": "품질", "QMR": "품질", "COR": "제약사항", "SAR": "제약사항", "PMR": "프로젝트관리", "GOV": "프로젝트관리", "PSR": "프로젝트지원",
    "CNR": "컨설팅", "CUR": "컨설팅", "CSR": "컨설팅", "CON": "컨설팅",
}
UNKNOWN = "기타"
# Display rules, first hit wins.
DISPLAY_RULES = (
    ("기능 요구사항", ("기능", "SFR", "AI 활용 업무", "AI 기반 솔루션", "그룹웨어", "서비스")),
    ("성능 요구사항", ("성능", "PER")),
    ("보안 요구사항", ("보안", "SER")),
    ("데이터 요구사항", ("데이터", "DAR", "ECM")),
    ("품질 요구사항", ("품질", "QUR")),
    ("인터페이스 요구사항", ("인터페이스", "INR")),
    ("제약사항", ("제약", "COR")),
    ("테스트 요구사항", ("테스트", "TER")),
    ("인프라·장비 요구사항", ("장비", "인프라", "시스템")),
    ("프로젝트 관리·지원 요구사항", ("프로젝트", "PMR", "PSR", "컨설팅", "CNR", "CUR", "거버넌스", "안전")),
)
# Categories by identifier prefix.
CATEGORIES = {"1_기능": ("SFR", "FUN", "AIP", "AIF", "SYS"), "2_인프라": ("ECR", "INF"), "3_보안": ("SER", "SEC"), "4_데이터연계": ("DAR", "DAT", "INR", "INT", "GW")}
OTHER_CATEGORY = "5_관리품질제약"


def display_type(raw: Column) -> Column:
    out = F.when(F.coalesce(raw, F.lit("")).isin("", "None"), "미지정 (None)")
    for name, keys in DISPLAY_RULES:
        hit = F.lit(False)
        for k in keys:
            hit = hit | raw.contains(k)
        out = out.when(hit, name)
    return out.otherwise(UNKNOWN)


def type_spelling(raw: Column) -> Column:
    """Spelling without ``(ABC)``, blanks and the word for requirement; NULL if nothing is left."""
    t = F.regexp_replace(raw, r"\([A-Z]{2,4}\)", "")
    return F.nullif(F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("요구사항"), F.lit("")), F.lit(""))


def id_prefix(requirement_id: Column) -> Column:
    return F.substring_index(requirement_id, "-", 1)


def _lookup(d: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.coalesce(key, F.lit("")))


def canonical_type(raw: Column, requirement_id: Column) -> tuple[Column, Column]:
    """(type, source): by spelling, else by prefix, else unknown. The maps are literals, so no join is needed."""
    text, prefix = _lookup(TEXT_TYPES, type_spelling(raw)), _lookup(PREFIX_TYPES, id_prefix(requirement_id))
    return F.coalesce(text, prefix, F.lit(UNKNOWN)), F.when(text.isNotNull(), "text").when(prefix.isNotNull(), "prefix").otherwise("none")


# Display names of identifier prefixes.
PREFIX_NAMES = {
    "SFR": "기능 요구사항 (System Feature / Functional)", "ECR": "인프라·장비 요구사항 (Equipment / Infrastructure)", "SER": "보안 요구사항 (Security Requirement)", "SEC": "보안 요구사항 (Security)",
    "INR": "인터페이스·연계 요구사항 (Interface)", "DAR": "데이터 요구사항 (Data Requirement)", "QUR": "품질 요구사항 (Quality Requirement)", "TER": "테스트 요구사항 (Test Requirement)",
    "PMR": "프로젝트 관리 요구사항 (Project Management)", "PSR": "프로젝트 지원·상주 요구사항 (Project Support)", "COR": "제약사항·법령 (Constraint / Compliance)", "CON": "컨설팅·전략수립 (Consulting)",
    "CSR": "컨설팅·전략과제 (Consulting Strategy)", "CUR": "공통/특수 요구사항 (Common/Custom)", "OTR": "기타·운영 요구사항 (Other/Operation)", "PER": "성능 요구사항 (Performance)",
}


def short_prefix(requirement_id: Column) -> Column:
    """Part before the first hyphen, or the first three characters where there is none."""
    return F.when(F.instr(requirement_id, "-") > 0, F.trim(F.substring_index(requirement_id, "-", 1))).otherwise(F.substring(requirement_id, 1, 3))


def prefix_name(requirement_id: Column) -> Column:
    return F.coalesce(_lookup(PREFIX_NAMES, short_prefix(requirement_id)), F.lit(UNKNOWN))


def category(requirement_id: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, keys in CATEGORIES.items():
        out = out.when(short_prefix(requirement_id).isin(*keys), name)
    return out.otherwise(OTHER_CATEGORY)


def with_types(rows: DataFrame) -> DataFrame:
    kind, source = canonical_type(F.col("requirement_type"), F.col("requirement_id"))
    return rows.withColumn("canonical_type", kind).withColumn("type_source", source).withColumn("display_type", display_type(F.col("requirement_type"))).withColumn("category", category(F.col("requirement_id")))
