"""Patterns and priorities of the ambiguity queue. Fixed values."""

TEXT_HINTS = {
    "domain": (r"(lfc|极充|超充|闪充|家充|充电站|充站|充电桩|充电枪|占位费|超时占位|"
               r"充电功率|功率只有|跳枪|地锁|异位充电|公共充电|自动闪充|"
               r"家充桩|充桩|电缆米数|充完电|驶离|闪充站|超充站|极充站|轻充站)"),
    "praise": r"(礼盒|盲盒|表扬|感谢|好看|爱了|专业|耐心|热情|满意|很好|不错|给力|赞)",
    "consult": r"(咨询|询问|请问|想了解|怎么预约|如何购买|什么时|收费标准|具体位置|勘测路径)",
    "issue": r"(不认可|用户反馈|反馈:|没有下一步|怎么没有|无法|功率只有|收取|投诉|不满|异常|坏了|没显示)",
}
DOMAIN_L2 = ("LFC问题", "车端充电问题")
CONSULT_L2 = "咨询与表扬"
PRIORITY = {
    "lfc_consult_vs_lfc": 100,
    "lfc_lfc_vs_consult": 98,
    "lfc_pure_consult": 95,
    "lfc_issue_signal": 92,
    "top_l1_nonissue_product": 88,
    "praise_vs_product": 85,
    "sales_praise_boundary": 82,
    "top_l1_product_nonissue": 75,
    "nonissue_l2_split": 70,
    "top_l1_service_nonissue": 65,
    "top_l1_nonissue_service": 60,
}
DOMAIN_REASONS = ("lfc_consult_vs_lfc", "lfc_lfc_vs_consult", "lfc_pure_consult", "lfc_issue_signal")
