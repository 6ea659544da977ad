"""Label vocabulary of the default pack."""

# The four top classes in display order, and the alias names in use.
L1_ORDER = ("产品质量类", "体验需求类", "服务类", "非问题")
PRODUCT, EXPERIENCE, SERVICE, NON_ISSUE = L1_ORDER
BUSINESS_L1 = (PRODUCT, SERVICE, EXPERIENCE)
L1_ALIASES = {
    "产品质量类": "产品质量类",
    "体验需求类": "体验需求类",
    "服务类": "服务类",
    "销售服务类": "服务类",
    "非问题": "非问题",
    "质量问题": "产品质量类",
    "产品质量": "产品质量类",
    "质量类": "产品质量类",
    "产品问题": "产品质量类",
    "体验需求": "体验需求类",
    "需求类": "体验需求类",
    "营销服务": "服务类",
    "服务问题": "服务类",
    "咨询类": "非问题",
    "咨询": "非问题",
    "其他非问题": "非问题",
}
# Containment rules tried in this order after the aliases.
# (equal to any of, or contains all of, or ends with) -> class
L1_CONTAINMENT = (
    ((), ("质量", "产品"), "", "产品质量类"),
    (("体验",), ("体验", "需求"), "", "体验需求类"),
    ((), ("营销", "服务"), "", "服务类"),
    (("售后", "销售服务"), (), "", "服务类"),
    ((), ("非问题",), "咨询", "非问题"),
)
# Names the earlier five-class feed used.
LEGACY_BY_L1 = {"产品质量类": "质量问题", "服务类": "营销服务", "体验需求类": "体验需求", "非问题": "非问题"}
LEGACY_CLASSES = ("质量问题", "营销服务", "体验需求", "咨询", "非问题")

# Display name of each model in a multi-value model field.
MODEL_NAMES = {"eletre": "Eletre", "emeya": "EMEYA", "emira": "Emira",
               "evora": "EVORA", "exige": "EXIGE", "elise": "Elise"}
