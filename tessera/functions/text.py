"""Caption and expression text: Column -> Column, all JVM-side but for the ratio of ``valid_negative``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heads that point at nothing, by profile.
PRONOUN_HEADS = ("它", "他", "她", "这个", "那个", "这些", "那些", "其", "该")
PRONOUN_HEADS_SHORT = ("它", "这个", "那个", "这些", "那些", "其", "该")

# Fixed value: the attribute phrase (numeral, measure word, up to 12 characters, an attribute, up to 10 more).
ATTRIBUTE_PHRASE = (
    r"[一二两三四五六七八九十百千万\d]+[个只张片条双件匹头颗株]?"
    r"[^，。；,.;]{1,12}?"
    r"(?:色|红|黄|蓝|绿|白|黑|灰|紫|粉|棕|橙|金|银|大|小|新|旧|长|短|高|矮)"
    r"[^，。；,.;]{0,10}"
)

# Fixed value: characters stripped from both ends of a generated line.
LINE_EDGE = "0-9.、\\-·* \\t\"'“”‘’"


@dataclass(frozen=True)
class ExpressionProfile:
    """Rules that differ between the two production profiles."""

    pronoun_heads: tuple[str, ...] = PRONOUN_HEADS
    require_substring: bool = True
    min_length: int = 2
    max_per_image: int = 8
    min_per_image: int = 1


DEFAULT_PROFILE = ExpressionProfile()
LEGACY_PROFILE = ExpressionProfile(pronoun_heads=PRONOUN_HEADS_SHORT, require_substring=False, max_per_image=6)


@dataclass(frozen=True)
class CleanParams:
    min_chars: int = 5
    max_chars: int = 200


def squeeze(text: Column) -> Column:
    """Whitespace runs (Unicode) become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column, params: CleanParams = CleanParams()) -> Column:
    """Squeezed text, or null if it is null or its length is out of bounds (longer texts are dropped, not cut)."""
    t = squeeze(text)
    return F.when(F.length(t).between(params.min_chars, params.max_chars), t)


def caption_ok(caption: Column, min_chars: int = 20, strip: bool = True, collapse: bool = False) -> Column:
    """Whether a caption is long enough; by profile it is stripped or collapsed first. Null is not."""
    c = squeeze(caption) if collapse else F.regexp_replace(caption, r"(?U)^\s+|\s+$", "") if strip else caption
    return F.coalesce(F.length(c) >= min_chars, F.lit(False))


def starts_with_any(text: Column, heads: tuple[str, ...]) -> Column:
    return text.rlike("^(?:" + "|".join(heads) + ")")


def valid_expression(expr: Column, caption: Column, profile: ExpressionProfile = DEFAULT_PROFILE) -> Column:
    ok = (F.length(expr) >= profile.min_length) & ~starts_with_any(expr, profile.pronoun_heads)
    if profile.require_substring:
        ok = ok & F.contains(caption, expr)
    return F.coalesce(ok, F.lit(False))


def parse_lines(raw: Column) -> Column:
    """Array of the lines of generated text, stripped of numbering, bullets and quotes; empty ones go.

    A leading digit that belongs to the phrase goes too.
    """
    edge = f"^[{LINE_EDGE}]+|[{LINE_EDGE}]+$"
    lines = F.split(F.coalesce(raw, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\u0085\u2028\u2029]")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), edge, "")), lambda x: x != "")


def attribute_expressions(caption: Column, profile: ExpressionProfile = DEFAULT_PROFILE) -> Column:
    """Attribute phrases found by pattern, trimmed and validated."""
    hits = F.transform(F.regexp_extract_all(caption, F.lit(ATTRIBUTE_PHRASE), F.lit(0)), lambda x: F.trim(x))  # F.trim itself would take the index as what to trim
    return F.filter(hits, lambda e: valid_expression(e, caption, profile))


def cap_expressions(expressions: Column, profile: ExpressionProfile = DEFAULT_PROFILE) -> Column:
    """Distinct in first-seen order, at most the profile's number; null if there are too few."""
    kept = F.slice(F.array_distinct(expressions), 1, profile.max_per_image)
    return F.when(F.size(kept) >= profile.min_per_image, kept)


@dataclass(frozen=True)
class WordGroups:
    """Groups of words that exclude each other, in priority order of strategies."""

    strategies: tuple[tuple[tuple[str, ...], ...], ...] = field(default_factory=tuple)


# Replacement vocabularies (colour, action, number, material).
COLOURS = ("红色", "黄色", "蓝色", "绿色", "白色", "黑色", "灰色", "紫色", "粉色", "棕色", "橙色", "金色", "银色")
ACTIONS = (("跳跃", "趴卧"), ("奔跑", "站立"), ("坐着", "站着"), ("躺", "站"), ("吃", "叼"), ("打开", "关闭"), ("举起", "放下"), ("穿", "脱"))
NUMBERS = ("一个", "两个", "三个", "四个", "一只", "两只", "三只", "一条", "两条", "一张", "两张")
MATERIALS = (("干净", "脏污"), ("完整", "破损"), ("新", "旧"), ("木质", "金属"), ("玻璃", "塑料"), ("皮质", "布艺"))
RULES = WordGroups((((COLOURS),), ACTIONS, ((NUMBERS),), MATERIALS))
RULES_ENGLISH = WordGroups(((("red", "blue", "green", "black", "white"),), (("small", "large"),)))


def replacements(expr: Column, groups: tuple[tuple[str, ...], ...], seed: int = 42, tries: int = 2) -> Column:
    """Array of up to ``tries`` texts with the earliest vocabulary word replaced by another of its group.

    The earliest hit over all words (ties by vocabulary order) picks the first group that holds it. Alternatives are
    tried in the order of a hash of seed, text and word, so the result does not depend on row order.
    """
    words = [(w, next(i for i, g in enumerate(groups) if w in g)) for g in groups for w in g]
    hits = F.filter(
        F.array(*[F.struct(F.instr(expr, w).alias("pos"), F.lit(i).alias("ord"), F.lit(w).alias("word"), F.lit(g).alias("grp")) for i, (w, g) in enumerate(words)]),
        lambda h: h["pos"] > 0,
    )
    first = F.array_min(hits)
    table = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    others = F.array_except(F.get(table, first["grp"]), F.array(first["word"]))
    ranked = F.array_sort(F.transform(others, lambda w: F.struct(F.sha1(F.concat_ws("|", F.lit(str(seed)), expr, w)).alias("k"), w.alias("w"))))
    made = F.transform(F.slice(ranked, 1, tries), lambda r: F.concat(F.substring(expr, F.lit(1), first["pos"] - 1), r["w"], F.substring(expr, first["pos"] + F.length(first["word"]), F.length(expr))))
    return F.when(F.size(hits) > 0, made).otherwise(F.expr("cast(array() as array<string>)"))


def make_key(image: Column, task: str, version: str, reason_id: Column | None = None, has_reason: Column | None = None) -> Column:
    """sha1 of image|task|version, and |reason_id where the record has that field, even if it is empty."""
    base = F.concat_ws("|", F.coalesce(image, F.lit("")), F.lit(task), F.lit(version))
    if reason_id is None:
        return F.sha1(base)
    return F.sha1(F.when(has_reason if has_reason is not None else reason_id.isNotNull(), F.concat_ws("|", base, F.coalesce(reason_id, F.lit("")))).otherwise(base))


def resolve_path(path: Column, root: str) -> Column:
    """Absolute paths stay, others are taken from ``root``."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def checkpoint_step(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"ckpt_step(\d+)\.pt$", 1), F.lit("")).cast("int")


def prompt(template: str, **fields: Column) -> Column:
    """``template`` with {name} replaced by columns; nulls become empty."""
    out: list[Column] = []
    rest = template
    while rest:
        at = min(((rest.find("{" + k + "}"), k) for k in fields if "{" + k + "}" in rest), default=None)
        if at is None:
            out.append(F.lit(rest))
            break
        pos, key = at
        out += [F.lit(rest[:pos]), F.coalesce(fields[key], F.lit(""))]
        rest = rest[pos + len(key) + 2 :]
    return F.concat(*out)


def chat_wrap(text: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), text, F.lit(after))
