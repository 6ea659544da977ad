"""A second pack whose patterns occur in the invented prose of the test tables.
Same shape as the default pack, so that the same operators run on it."""

INSIGHT = dict(praise="thank|merci|eauaux", escalate="nting|eaueau|schsch", help="ereher|ouelle|unglich",
               consult="whth|quoi|icht", suggest="ould|rait|lich", fault="tionou|eauré|ungen",
               inform="for the|pour|für", refund="blees|paier|keit", visit="onhe|chan|auf",
               repair="thin|aile|ver", explain="rest|vien|gen", feature="andst|elle", severe="ndndnd|èèè|ßß",
               moderate="tion|ment|lich", urgent="the the|la la|die die", repeat=r"(an|en|de)\s+(an|en|de)")

P, E, S, N = "产品质量类", "体验需求类", "服务类", "非问题"


def _rule(parts, l1, l2, l3, confidence, deny=""):
    return {"parts": parts, "l1": l1, "l2": l2, "l3": l3, "confidence": confidence, "deny": deny}


PRIORITY = [_rule(("zzzq|schsch",), N, "L2-0", "rare", 0.88), _rule(("eaueau", "ouelle|chch"), P, "L2-1", "pair", 0.93),
            _rule(("ingthe",), S, "L2-2", "deny", 0.91, "ouou|ndnd"), _rule(("ungkeit", "lichsch"), E, "L2-3", "late", 0.90)]
SCORES = {"product": [dict(weight=3.0, words=("tion", "ment", "ung")), dict(weight=2.5, words=("THE", "eaux"), lower=True),
                      dict(weight=4.0, words=("ing",), also=(("ther", "ent"), ("and",)))],
          "service": [dict(weight=7.0, words=("ouelle", "nting"), each=False), dict(weight=3.5, words=("lich", "pour", "with")),
                      dict(weight=3.0, words=("sch",), unless=("keit", "auf"))],
          "experience": [dict(weight=5.0, words=("avec", "und", "que"))],
          "none": [dict(weight=3.8, words=("le", "la", "der", "of", "on"), unless=("éeau", "ndnd", "schsch"))]}
ROUTES = {P: [dict(target="L2-0", weight=12, words=("tion",)), dict(target="L2-1", weight=18, words=("eauré", "ungen")), dict(target="L2-2", weight=12, words=("ment",)),
              dict(target="L2-4", weight=18, words=("hat",), also=("with",), unless=("éé",))],
          S: [dict(target="L2-1", weight=16, words=("lich", "pour")), dict(target="L2-3", weight=17, words=("ouelle",))],
          E: [dict(target="L2-2", weight=10, words=("und",))], N: [dict(target="L2-0", weight=10, words=("la la",))]}
SYMPTOMS = [dict(when_l1=P, words=("ating",), l1=P, l2="L2-9", l3="sym-a", confidence=0.52), dict(when_l1=P, words=("re",), l1=P, l2="L2-8", l3="sym-b", confidence=0.52)]
WEAK = {"wish_words": ("avec", "und"), "experience": ("L2-7", "weak-e", 0.45), "service": ("L2-6", "weak-s", 0.40)}
# (l1, l2, l3, frequency)
TAXONOMY = [(P, "L2-0", "tionou", 40), (P, "L2-0", "heren", 12), (P, "L2-0", "通用", 2), (P, "L2-1", "eauré", 30), (P, "L2-1", "ungen", 9), (P, "L2-2", "menter", 7),
            (P, "L2-4", "hatwh", 5), (S, "L2-1", "lichsch", 20), (S, "L2-1", "无明确项", 3), (S, "L2-3", "ouelle", 15), (E, "L2-2", "undauf", 6), (N, "L2-0", "la", 4)]
CLUSTERS = [(P, "L2-0", "heren", 5, ["andst", "ionin"], ["ther"]), (P, "L2-0", "tionou", 3, ["ingth"], ["ntwh", "er"]), (S, "L2-1", "lichsch", 2, ["gen"], ["auf"]),
            (P, "L2-4", "zzzz", 1, ["zzz"], ["hatwh"])]
WHITELIST = [(P, "L2-0"), (P, "L2-1"), (P, "L2-2"), (S, "L2-1"), (S, "L2-3"), (S, "L2-4"), (E, "L2-2"), (E, "L2-3"), (N, "L2-0")]
CONFLICTS = [dict(id="C1", when_l1=N, keyword_group="a"), dict(id="C2", when_l1=S, keyword_group="b"), dict(id="C3", when_l1=E, keyword_group="b"), dict(id="C4", when_l1=S, keyword_group="a")]
CONFLICT_GROUPS = {"a": ("eaux", "tion"), "b": ("ould", "chung", "paier")}
GUARD = {"signals": dict(issue="tion", exempt="zz|ndnd", negative="ment", product_tilt="eau|ing", service_tilt="lich|pour", experience_tilt="avec.{0,30}que", fault="ther|tre",
                         wish="und", service_word="sch", domain="re", domain_complaint="ouou|thth", domain_consult="le", service_issue="ungkeit|nding", station_inquiry="zzz",
                         station="ationou", supplier="qq", vehicle_dominant="aile", context_block="yyy", coordination="inter|vien", coordination_block="tion.*tion.*tion",
                         assist="paier", assist_intent="des", explicit_issue="eaueau", story="pa", demand="que"),
         "service_l2": [("ouelle", "L2-3"), ("lich", "L2-1")], "service_l2_default": "L2-4", "product_l2": [("eau", "L2-1")], "product_l2_default": "L2-0",
         "experience_l2_default": "L2-2", "story_source": "web|s1", "context_keep": {E: ("L2-2",), P: ("L2-2",), S: ("L2-4",)}}
PACK = dict(priority=PRIORITY, scores=SCORES, routes=ROUTES, route_default={N: "L2-0"}, symptoms=SYMPTOMS, weak=WEAK, conflicts=CONFLICTS, conflict_groups=CONFLICT_GROUPS,
            negative="ment", consult_l2="L2-3", relocate=[("ouelle", S, "L2-3"), ("eau", P, "L2-1"), ("lich", E, "L2-2")], relocate_default=(P, "L2-0"),
            capture=dict(
                signals=dict(neg="schsch|ndnd", dom="ouou", dom_also="re", open="paier", open_unless="le", short="the|le", praise="thank|éeauaux", ask="icht", ask_also="der"),
                terms=dict(in_dom=("all", "dom", "dom_also")), blocked=[("neg", "neg"), ("dom", "in_dom"), ("open", ("all", "open", ("not", "open_unless")))],
                eligible=[("short", ("max", 300, "short")), ("praise", "praise"), ("ask", ("all", "ask", "ask_also"))]),
            domain_l2=dict(vehicle_l2="L2-2", station_l2="L2-1", vehicle_side="mentre", supplier="qq", inquiry="zzz", strong_fault="yy", station_fault="eauou", station="ationou"),
            guard=GUARD, facilities=("eau", "ung"), triggers=("tionou", "ndnd"), non_issue=("zzz", "merci", "thank", "schsch"), non_issue_negations=("la la", "die die"),
            weights=[("产品质量问题", 10, ("tion", "ment")), ("销售服务问题", 5, ("lich", "pour", "with", "ther")), ("体验需求", 8, ("avec", "und")), ("产品咨询", 3, ("que", "of", "der", "la", "on"))],
            boundary_words=dict(fault=("schsch", "eaueau"), non_issue=("zzz", "merci", "thank"), suggest=("avec", "ould"), service=("lich", "pour")),
            boundary=(("fault", "产品质量问题", "f"), ("non_issue", "非问题", "n"), ("suggest", "体验需求", "s"), ("service", "销售服务问题", "v")),
            mixed=((E, ("tion", "ung"), "exp+fault"), (S, ("eaueau",), "srv+fault"), (P, ("avec", "ould"), "prod+wish")))
