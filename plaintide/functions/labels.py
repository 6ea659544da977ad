"""Class names, their aliases and the four precedence rules for effective labels."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from plaintide.functions.common import blank, col, filled, first_filled, squeeze_short, strip, text
from plaintide.functions.meta import json_text
from plaintide.packs import labels as pack


def _containment_pattern(rules) -> tuple[str, str, dict[str, str]]:
    """The ordered containment rules as one alternation: pattern, replacement and a table from the
    replaced text to the class. Alternatives are tried left to right, so the first rule wins, and
    one compact pattern keeps the generated code small where a label is used many times."""
    parts, table = [], {}
    for equal, holds, ending, canon in rules:
        parts += [f"({w})" for w in equal]
        if holds:
            rest = "".join(f"(?=.*{w})" for w in holds[1:])
            parts.append(f"{rest}.*({holds[0]}).*")
        if ending:
            parts.append(f".*({ending})")
        for word in (*equal, *holds[:1], *([ending] if ending else [])):
            table["#" + word] = canon
    groups = "".join(f"${i + 1}" for i in range(len(parts)))
    return f"^(?:{'|'.join(parts)})$", "#" + groups, table


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def try_canonicalize_l1(c: Column | str, aliases=pack.L1_ALIASES, rules=pack.L1_CONTAINMENT) -> Column:
    """One of the canonical classes, or NULL when the name is not recognised."""
    t = squeeze_short(c)
    pattern, replacement, table = _containment_pattern(rules)
    return F.coalesce(_lookup(aliases, t), _lookup(table, F.regexp_replace(t, pattern, replacement)))


def canonicalize_l1(c: Column | str, default: str = pack.SERVICE) -> Column:
    return F.coalesce(try_canonicalize_l1(c), F.lit(default))


def canonical_or_blank(c: Column | str, default: str = pack.SERVICE) -> Column:
    """Canonical class, but an empty name stays empty."""
    return F.coalesce(try_canonicalize_l1(F.coalesce(col(c), F.lit("")), {"": "", **pack.L1_ALIASES}), F.lit(default))


def l1_filter_variants(name: str, aliases=pack.L1_ALIASES, default: str = pack.SERVICE) -> list[str]:
    """The canonical class of ``name`` and every alias of it, for an IN list."""
    squeezed = "".join(name.split())
    canon = aliases.get(squeezed)
    if canon is None:
        for equal, holds, ending, target in pack.L1_CONTAINMENT:
            hit = (squeezed in equal or (holds and all(h in squeezed for h in holds))
                   or (ending and squeezed.endswith(ending)))
            if hit:
                canon = target
                break
    canon = canon or default
    return sorted({canon, *[a for a, c in aliases.items() if c == canon]})


def strip_non_issue(l1: Column | str, l2: Column | str) -> tuple[Column, Column]:
    """Canonical L1; the non-issue class carries no L2; an empty L1 keeps its L2."""
    c1 = canonical_or_blank(l1)
    return c1, F.when(c1 == pack.NON_ISSUE, F.lit("")).otherwise(text(l2))


def first_keyword(c: Column | str) -> Column:
    return strip(F.substring_index(F.coalesce(col(c), F.lit("")), ",", 1))


def is_reviewed(status: str = "review_status") -> Column:
    return F.coalesce(F.col(status) == 1, F.lit(False))


def _word(c: Column) -> Column:
    """Cell text where the words none/null also count as empty."""
    t = text(c)
    return F.when(F.lower(t).isin("none", "null"), F.lit("")).otherwise(t)


def report_labels(meta: str = "v3_label_meta") -> tuple[Column, Column]:
    """Reports: the human pair if reviewed with an L1, else model columns, JSON, feed columns."""
    human = is_reviewed() & filled("review_l1")
    model_l1 = first_filled(_word(F.col("v3_l1")), json_text(meta, "l1"), "model_class")
    model_l2 = first_filled(_word(F.col("v3_l2")), json_text(meta, "l2"), first_keyword("model_keyword"))
    l1 = F.when(human, text("review_l1")).otherwise(model_l1)
    l2 = F.when(human, first_filled("review_l2", first_keyword("model_keyword"))).otherwise(model_l2)
    return canonical_or_blank(l1), l2


def insight_labels(meta: str = "v3_label_meta") -> tuple[Column, Column, Column]:
    """Insight: per level, human over model if reviewed, else model; gaps from JSON."""
    def level(k: str, *paths: str) -> Column:
        human = F.when(is_reviewed(), F.nullif(F.col(f"review_{k}"), F.lit("")))
        stored = strip(F.coalesce(human, F.col(f"v3_{k}")))
        return first_filled(stored, *[json_text(meta, p) for p in paths])
    return level("l1", "l1"), level("l2", "l2"), level("l3", "l3", "level3")


def review_labels(meta: str = "v3_label_meta") -> tuple[Column, Column]:
    """Review desk: human, then JSON, then feed columns; stored model columns are ignored.
    JSON fills L2 only when it also supplied L1."""
    no_human = blank("review_l1")
    l1 = first_filled("review_l1", json_text(meta, "l1"), "model_class")
    l2 = first_filled("review_l2", F.when(no_human, json_text(meta, "l2")), first_keyword("model_keyword"))
    return l1, l2


def model_labels(meta: str = "v3_label_meta") -> tuple[Column, Column]:
    """Evaluation: JSON first, then the feed columns."""
    return (first_filled(json_text(meta, "l1"), "model_class"),
            first_filled(json_text(meta, "l2"), first_keyword("model_keyword")))


def stored_model_labels(meta: str = "v3_label_meta") -> tuple[Column, Column]:
    """Accuracy desk: stored columns, JSON, feed columns."""
    return (first_filled("v3_l1", json_text(meta, "l1"), "model_class"),
            first_filled("v3_l2", json_text(meta, "l2"), first_keyword("model_keyword")))


def list_canonical_l1(meta: str = "v3_label_meta") -> Column:
    """Canonical class shown in lists: human, model column, JSON, feed class."""
    return canonicalize_l1(first_filled("review_l1", "v3_l1", json_text(meta, "l1"), "model_class"))


def legacy_class(c: Column | str, exact=pack.LEGACY_BY_L1, names=pack.LEGACY_CLASSES) -> Column:
    """Old five-class name: exact map, else the first name that contains or is contained."""
    v = F.coalesce(col(c), F.lit(""))
    out = F.when(v == "", F.lit(None).cast("string"))
    for k, target in exact.items():
        out = out.when(v == k, target)
    for n in names:
        out = out.when(v.contains(n) | F.lit(n).contains(v), n)
    return out


def effective_confidence() -> Column:
    return F.coalesce(F.col("v3_confidence"), F.col("match_score"), F.lit(0.0))


def match_family(c: Column | str = "v3_match_type") -> Column:
    v = F.coalesce(col(c), F.lit(""))
    return (F.when(v == "clean_l1", "clean").when(v.ilike("llm%") | v.ilike("qwen%"), "llm")
            .when(v != "", "rule").otherwise(""))
