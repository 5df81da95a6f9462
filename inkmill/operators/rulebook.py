"""What each rule reports: category, confidence, score, proposed action and reason.

Fixed values: names, scores and wording are part of the result.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Fact(NamedTuple):
    rule: str
    category: str
    confidence: str
    score: float
    action: str
    reason: str


_PUNCT, _RESIDUE, _AD, _BAD, _TRAD = (
    "punctuation", "web_residue", "advertisement", "abnormal_character", "traditional_character",
)

PAGE_NUMBER = Fact("standalone_page_number", _RESIDUE, "high", 0.95, "remove", "独立数字行明显不符合正文结构，疑似网页页码残留")
PAGE_NUMBER_WEAK = Fact("standalone_page_number", _RESIDUE, "medium", 0.6, "report", "独立数字行可能是正文内容，保留原文并记录")
EMPTY_DIALOGUE = Fact("empty_dialogue_fragment", _RESIDUE, "high", 0.96, "remove", "整段只有引号和省略号，没有实际正文内容")
ISOLATED_ESCAPE = Fact("isolated_quote_escape", _RESIDUE, "high", 0.97, "remove", "独立的反斜杠或引号片段是明显的网页转义残留")

STRONG_PHRASE = Fact("strong_promotion_phrase", _AD, "high", 0.99, "delete", "包含明确的网站推广或公众号广告语句")
PROMO_URL = Fact("promotional_url", _AD, "high", 0.98, "delete", "短段落中包含网址，并带有明显的推广特征")
URL_IN_TEXT = Fact("url_in_text", _AD, "medium", 0.62, "report", "正文中出现网址，但上下文不足以确定为广告，保留原文")
SOFT_CUES = Fact("multiple_soft_promotion_cues", _AD, "medium", 0.58, "report", "段落包含多个推广相关词语，疑似广告但保留原文")

ESCAPED_QUOTE = Fact("escaped_quote_artifact", _PUNCT, "high", 0.96, "replace", "正文中的反斜杠转义引号是明显的网页残留")
MIXED_DASH = Fact("mixed_dash_sequence", _PUNCT, "high", 0.94, "replace", "中文正文中的混合长横线属于明显异常标点")
REPEATED_COMMA = Fact("repeated_cjk_comma", _PUNCT, "high", 0.98, "replace", "连续重复逗号属于明显标点异常")
REPEATED_PERIOD = Fact("repeated_cjk_period", _PUNCT, "high", 0.98, "replace", "连续重复句号属于明显标点异常")
ASCII_COMMA = Fact("ascii_comma_in_chinese", _PUNCT, "high", 0.95, "replace", "中文语境中的英文逗号明显不匹配")
ASCII_PERIOD = Fact("ascii_period_in_chinese", _PUNCT, "high", 0.95, "replace", "中文语境中的英文句号明显不匹配")
ASCII_QUESTION = Fact("ascii_question_in_chinese", _PUNCT, "high", 0.95, "replace", "中文语境中的英文问号明显不匹配")
ASCII_EXCLAMATION = Fact("ascii_exclamation_in_chinese", _PUNCT, "high", 0.95, "replace", "中文语境中的英文叹号明显不匹配")
ASCII_ELLIPSIS = Fact("ascii_ellipsis_in_chinese", _PUNCT, "high", 0.93, "replace", "中文语境中的连续英文句点是明显省略号写法")
STRAIGHT_QUOTE = Fact("straight_quote_in_chinese", _PUNCT, "high", 0.9, "replace", "中文段落中的直引号可保守替换为成对中文引号")
UNCLOSED_QUOTE = Fact("unclosed_dialogue_quote", _PUNCT, "high", 0.93, "replace", "对话以句末标点结束但缺少对应的闭引号")
LONG_EXPRESSION = Fact("long_repeated_expression", _PUNCT, "low", 0.35, "report", "连续多个感叹号或问号可能是作者表达，保留原文")
UNMATCHED_QUOTES = Fact("unmatched_chinese_quotes", _PUNCT, "medium", 0.55, "report", "中文引号数量不配对，无法可靠判断修改位置，保留原文")

REPLACEMENT_CHAR = Fact("replacement_character", _BAD, "high", 0.99, "remove", "出现 Unicode 替换字符，说明抓取或编码过程损坏")
CONTROL_CHAR = Fact("control_or_zero_width_character", _BAD, "high", 0.98, "remove", "出现零宽或控制字符，不属于正文排版")
_CONTEXT = "contextual_traditional_character"
TRAD_REPEATED = Fact(_CONTEXT, _TRAD, "medium", 0.58, "report", "同一段落多次出现该繁体字，可能是作者或专有名词用法，保留原文")
TRAD_EVIDENCE = Fact(_CONTEXT, _TRAD, "high", 0.96, "replace", "全文简体风格明显，转换后的词语在全文其他位置有相同写法")
TRAD_LIKELY = Fact(_CONTEXT, _TRAD, "medium", 0.72, "report", "全文以简体为主，该繁体字可能是输入异常，但上下文证据不足")
TRAD_UNSURE = Fact(_CONTEXT, _TRAD, "low", 0.35, "report", "疑似繁简体混用，但可能是人名、专有名词或作者用法，保留原文")

# Score and reason of a blacklist finding come from its match.
BLACKLIST_HIGH = Fact("user_ad_blacklist", _AD, "high", 1.0, "delete", "与用户广告黑名单高度重合（相似度 %d%%，匹配方式 %s）")
BLACKLIST_MEDIUM = Fact("user_ad_blacklist", _AD, "medium", 0.78, "report", "与用户广告黑名单高度重合（相似度 %d%%，匹配方式 %s）")

FACTS = [f for f in list(globals().values()) if isinstance(f, Fact)]
_IDS = {f: i for i, f in enumerate(FACTS)}
APPLICABLE = [i for i, f in enumerate(FACTS) if f.confidence == "high" and f.action in ("delete", "remove", "replace")]
_FACT_TYPE = "struct<rule:string,category:string,confidence:string,score:double,action:string,reason:string>"

# Inside a chapter a finding is only the number of its fact, the text found and its replacement.
ISSUE = "struct<fact:int,original:string,replacement:string>"


def number(fact: Fact) -> int:
    return _IDS[fact]


def issue(fact: Fact, original: Column, replacement: Column | str) -> Column:
    """One finding as a compact struct."""
    new = F.lit(replacement) if isinstance(replacement, str) else replacement
    return F.struct(F.lit(_IDS[fact]).alias("fact"), original.alias("original"), new.alias("replacement"))


def no_issues() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def may_apply(found: Column) -> Column:
    """Findings that auto mode carries out."""
    return found["fact"].isin(APPLICABLE)


def is_fact(found: Column, *facts: Fact) -> Column:
    return found["fact"].isin([_IDS[f] for f in facts])


def fact_of(found: Column) -> Column:
    """The fact of a finding, from a literal table."""
    table = F.from_json(F.lit(json.dumps([f._asdict() for f in FACTS])), f"array<{_FACT_TYPE}>")
    return F.get(table, found["fact"])


def finding_columns(found: Column) -> list[Column]:
    """The public columns of a settled finding (``applied``, ``score`` and ``method`` added)."""
    fact = fact_of(found)
    percent = F.bround(found["score"] * 100, 0).cast("int")
    reason = F.when(
        found["score"].isNotNull(), F.format_string(BLACKLIST_HIGH.reason, percent, found["method"])
    ).otherwise(fact["reason"])
    return [
        fact["category"].alias("category"),
        fact["confidence"].alias("confidence"),
        F.coalesce(found["score"], fact["score"]).alias("confidence_score"),
        fact["rule"].alias("rule"),
        reason.alias("reason"),
        found["original"].alias("original"),
        found["replacement"].alias("replacement"),
        F.when(found["applied"], fact["action"]).otherwise(F.lit("report")).alias("action"),
        found["applied"].alias("applied"),
    ]
