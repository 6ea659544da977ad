"""Text builders for the DuckDB twins. Written apart from the Spark functions on purpose:
a twin that called the same builder would only agree with itself."""
from __future__ import annotations

WS = (r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}]")


def s(x: str) -> str:
    """Trimmed, NULL as empty."""
    return f"coalesce(regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '^{WS}+', ''), '{WS}+$', ''), '')"


def n(x: str) -> str:
    """Trimmed, empty as NULL."""
    return f"nullif({s(x)}, '')"


def ff(*xs: str) -> str:
    return "coalesce(" + ", ".join(n(x) for x in xs) + ", '')"


def sq(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def try_canon(x: str) -> str:
    t = sq(x)
    return (f"(CASE WHEN {t} IN ('产品质量类','质量问题','产品质量','质量类','产品问题') THEN '产品质量类' "
            f"WHEN {t} IN ('体验需求类','体验需求','需求类') THEN '体验需求类' "
            f"WHEN {t} IN ('服务类','销售服务类','营销服务','服务问题') THEN '服务类' "
            f"WHEN {t} IN ('非问题','咨询类','咨询','其他非问题') THEN '非问题' "
            f"WHEN contains({t},'质量') AND contains({t},'产品') THEN '产品质量类' "
            f"WHEN {t} = '体验' OR (contains({t},'体验') AND contains({t},'需求')) THEN '体验需求类' "
            f"WHEN contains({t},'营销') AND contains({t},'服务') THEN '服务类' "
            f"WHEN {t} IN ('售后','销售服务') THEN '服务类' "
            f"WHEN contains({t},'非问题') OR ends_with({t},'咨询') THEN '非问题' END)")


def canon(x: str) -> str:
    return f"coalesce({try_canon(x)}, '服务类')"


def canon_b(x: str) -> str:
    """Canonical, blank stays blank."""
    return f"(CASE WHEN {s(x)} = '' THEN '' ELSE {canon(x)} END)"


def js(doc: str, key: str) -> str:
    """JSON key as text or NULL; guarded against broken text."""
    return (f"(CASE WHEN json_valid({doc}) AND json_type(CASE WHEN json_valid({doc}) THEN {doc} END) = 'OBJECT' "
            f"THEN json_extract_string(CASE WHEN json_valid({doc}) THEN {doc} END, '$.{key}') END)")


def kw1(x: str = "model_keyword") -> str:
    return s(f"split_part(coalesce({x},''), ',', 1)")


REVIEWED = "coalesce(review_status = 1, false)"
_HUM = f"({REVIEWED} AND {s('review_l1')} <> '')"
_M = "v3_label_meta"

# Reports: (l1, l2)
REP_L1 = (f"(CASE WHEN {_HUM} THEN {canon('review_l1')} ELSE "
          f"{canon_b('coalesce(' + n('v3_l1') + ',' + n(js(_M, 'l1')) + ',' + n('model_class') + chr(44) + chr(39)*2 + ')')} END)")
REP_L2 = (f"(CASE WHEN {_HUM} THEN {ff('review_l2', kw1())} ELSE {ff('v3_l2', js(_M, 'l2'), kw1())} END)")
# Review desk
REV_L1 = ff("review_l1", js(_M, "l1"), "model_class")
REV_L2 = (f"coalesce({n('review_l2')}, CASE WHEN {s('review_l1')} = '' THEN {n(js(_M, 'l2'))} END, "
          f"{n(kw1())}, '')")
# Evaluation
MOD_L1 = ff(js(_M, "l1"), "model_class")
MOD_L2 = ff(js(_M, "l2"), kw1())
# Accuracy desk
ACC_L1 = ff("v3_l1", js(_M, "l1"), "model_class")
ACC_L2 = ff("v3_l2", js(_M, "l2"), kw1())


def _ins(k: str, *alts: str) -> str:
    stored = f"coalesce(CASE WHEN {REVIEWED} THEN nullif(review_{k}, '') END, v3_{k})"
    return ff(stored, *alts)


INS_L1 = _ins("l1", js(_M, "l1"))
INS_L2 = _ins("l2", js(_M, "l2"))
INS_L3 = _ins("l3", js(_M, "l3"), js(_M, "level3"))

_RAW_DAY = f"replace(replace({ff('create_time', 'reviewed_at', 'created_at')}, '/', '-'), '.', '-')"
DAY = (f"(CASE WHEN length({_RAW_DAY}) >= 10 THEN substr({_RAW_DAY}, 1, 10) "
       f"WHEN length({_RAW_DAY}) >= 7 THEN substr({_RAW_DAY}, 1, 7) || '-01' ELSE '' END)")
MONTH = f"substr({DAY}, 1, 7)"


def time_of(x: str) -> str:
    t = f"replace({s(x)}, '/', '-')"
    rx = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?"
    part = [f"regexp_extract({t}, '{rx}', {i})" for i in range(1, 7)]
    pad = [f"lpad({p}, 2, '0')" for p in part[1:]]
    built = (f"{part[0]} || '-' || {pad[0]} || '-' || {pad[1]} || ' ' || "
             f"{pad[2]} || ':' || {pad[3]} || ':' || {pad[4]}")
    return f"(CASE WHEN {part[0]} <> '' THEN try_cast({built} AS TIMESTAMP) END)"


EVENT_TS = f"coalesce({time_of('reviewed_at')}, {time_of('create_time')})"
ISO_RAW = "coalesce(nullif(reviewed_at, ''), create_time)"
ISO_DAY = (f"(CASE WHEN regexp_matches({ISO_RAW}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') "
           f"THEN try_cast(substr({ISO_RAW}, 1, 10) AS DATE) END)")
CN = (f"({s('country')} = '' OR contains({s('country')}, '中国') OR upper({s('country')}) IN ('CN','CHINA'))")


def pct(a: str, b: str, d: int = 2) -> str:
    return f"round(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) * 100.0::DOUBLE / ({b}) END, {d})"


def share(a: str, b: str, d: int = 4) -> str:
    return f"round(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) * 1.0::DOUBLE / ({b}) END, {d})"
