"""Rule configuration: shipped defaults, overridden file by file from a user directory."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

# Default advertisement rules.
DEFAULT_AD_RULES = {
    "url_pattern": "(?:https?://|www\\.)[^\\s，。！？；：\"'<>]+",
    "domain_pattern": "\\b(?:[a-zA-Z0-9-]+\\.)+(?:com|net|org|cc|cn|io|me|top|xyz)(?:/[^\\s]*)?",
    "strong_phrases": [
        "本章由.{0,40}(?:提供|整理|发布)",
        "请(?:记住|收藏)本站",
        "更多精彩内容.{0,20}(?:访问|点击|请)",
        "本书首发于.{0,40}",
        "最新网址.{0,30}",
        "无弹窗.{0,20}(?:阅读|网站|小说)",
        "(?:关注|搜索).{0,20}公众号",
        "扫描.{0,10}二维码",
        "(?:加入|书友).{0,10}QQ群",
    ],
    "promo_cues": [
        "请收藏", "记住本站", "访问", "首发", "最新章节", "无弹窗", "公众号", "二维码", "QQ群", "微信号",
        "网址", "域名", "免费阅读",
    ],
    "soft_cues": ["微信", "网站", "最新章节", "免费", "收藏", "关注", "群", "网址"],
}

# Traditional characters and their simplified forms.
DEFAULT_TRADITIONAL = {
    "這": "这", "說": "说", "來": "来", "時": "时", "過": "过", "後": "后", "裡": "里", "裏": "里", "個": "个", "國": "国",
    "學": "学", "現": "现", "對": "对", "於": "于", "與": "与", "為": "为", "發": "发", "見": "见", "開": "开", "關": "关",
    "還": "还", "氣": "气", "實": "实", "體": "体", "靈": "灵", "無": "无", "問": "问", "麼": "么", "們": "们", "將": "将",
    "軍": "军", "變": "变", "邊": "边", "兒": "儿", "書": "书", "長": "长", "門": "门", "間": "间", "東": "东", "頭": "头",
    "內": "内", "風": "风", "親": "亲", "愛": "爱", "樂": "乐", "難": "难", "龍": "龙", "華": "华", "萬": "万", "億": "亿",
    "歲": "岁", "點": "点", "處": "处", "動": "动", "場": "场", "從": "从", "會": "会", "話": "话", "進": "进", "遠": "远",
    "聲": "声", "結": "结", "給": "给", "讓": "让", "讀": "读", "寫": "写", "聽": "听", "買": "买", "賣": "卖", "車": "车",
    "馬": "马", "鳥": "鸟", "魚": "鱼", "陽": "阳", "陰": "阴", "雲": "云", "電": "电", "題": "题", "類": "类", "經": "经",
    "總": "总", "戰": "战", "師": "师", "義": "义", "習": "习", "憶": "忆", "應": "应", "願": "愿", "語": "语", "誰": "谁",
    "論": "论", "識": "识", "張": "张",
}


@dataclass(frozen=True)
class Rules:
    """Small driver-side configuration; it becomes literals in the plan."""

    url_pattern: str = ""
    domain_pattern: str = ""
    strong_phrases: list[str] = field(default_factory=list)
    promo_cues: list[str] = field(default_factory=list)
    soft_cues: list[str] = field(default_factory=list)
    whitelist: list[str] = field(default_factory=list)
    traditional: dict[str, str] = field(default_factory=dict)


def _read(folder: Path | None, name: str) -> dict:
    """A JSON object, or nothing when the file is missing or broken."""
    if folder is None:
        return {}
    try:
        payload = json.loads((folder / name).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return payload if isinstance(payload, dict) else {}


def merge(base: dict, override: dict) -> dict:
    """Objects are merged one level deep, everything else is replaced."""
    both_objects = {k for k, v in override.items() if isinstance(v, dict) and isinstance(base.get(k), dict)}
    return base | override | {k: base[k] | override[k] for k in both_objects}


def _texts(value) -> list[str]:
    return [str(v) for v in value] if isinstance(value, list) else []


def _pattern(value) -> str:
    """A usable pattern, or no pattern."""
    try:
        re.compile(str(value))
    except re.error:
        return ""
    return str(value)


def make_rules(ad_rules: dict, whitelist: list, traditional: dict) -> Rules:
    return Rules(
        url_pattern=_pattern(ad_rules.get("url_pattern", "")),
        domain_pattern=_pattern(ad_rules.get("domain_pattern", "")),
        strong_phrases=[p for p in map(_pattern, _texts(ad_rules.get("strong_phrases"))) if p],
        promo_cues=_texts(ad_rules.get("promo_cues")),
        soft_cues=_texts(ad_rules.get("soft_cues")),
        whitelist=_texts(whitelist),
        traditional={
            k: v for k, v in traditional.items() if isinstance(v, str) and len(k) == 1 and len(v) == 1
        },
    )


def load_rules(user_dir: str | Path | None = None) -> Rules:
    """Default rules with the user's ``ad_rules.json``, ``whitelist.json`` and ``traditional_map.json``."""
    folder = Path(user_dir) if user_dir is not None else None
    whitelist = merge({"terms": []}, _read(folder, "whitelist.json"))
    return make_rules(
        merge(DEFAULT_AD_RULES, _read(folder, "ad_rules.json")),
        whitelist["terms"],
        merge(DEFAULT_TRADITIONAL, _read(folder, "traditional_map.json")),
    )
