"""Patterns from which the insight fields are read. Fixed values."""

PRAISE = "表扬|感谢|点赞|好评|满意|五星|非常棒|太棒了|很赞|服务很好|态度很好"
ESCALATE = "投诉|曝光|媒体|315|消协|律师|告你们|举报|维权|12315|强烈不满|愤怒|忍无可忍"
HELP = "求助|怎么办|谁能帮|请协助|请帮忙|希望帮忙|能否帮忙|希望处理|请求处理|帮我看看"
CONSULT = "请问|咨询|想问|问一下|了解一下|是否正常|是不是|能不能|可不可以|如何|怎么用"
SUGGEST = "建议|希望增加|希望加入|最好能|能不能加|功能实现|期待.*功能|建议优化"
FAULT = "故障|异常|失灵|黑屏|死机|报错|告警|报警|无法|打不开|启动不了|充不了|漏油|异响|卡顿|漂移"
INFORM = "告知|通知一下|反馈一下|仅供参考|同步一下"
REFUND = "退款|退定|退车|赔偿|赔付|补偿金|索赔"
VISIT = "上门|到店|到府|外出救援|道路救援|拖车"
REPAIR = "维修|返修|保修|质保|更换|换件|进站|维保|检修"
EXPLAIN = "解释|说明|为什么|为何|原因|答复|回复一下"
FEATURE = "增加功能|实现功能|加上.*功能|开通|开通权限|开通权益"
SEVERE = ("无法启动|不能启动|无法行驶|动不了|刹车失灵|制动失效|起火|冒烟|自燃|"
          "漏电|失控|安全气囊|碰撞|漏油严重|动力中断|趴窝|抛锚")
MODERATE = "故障|异常|告警|报警|黑屏|死机|无法充电|充不进|门打不开|钥匙失灵|异响明显"
URGENT = r"催|加急|尽快|马上|立刻|紧急|今天必须|仍未解决|一直没|多次反馈|第\s*\d+\s*次|一再|反复联系"
REPEAT = r"第\s*[一二三四五六七八九十\d]+\s*次|之前反馈|上次反馈|再次反馈|反复|又出现|还是没解决|仍未解决|老问题"
GENERIC_L3 = ("通用", "其他-待归类")
SEVERITY_WEIGHT = {"高": 3, "中": 2, "低": 1}

DEFAULT = dict(praise=PRAISE, escalate=ESCALATE, help=HELP, consult=CONSULT, suggest=SUGGEST,
               fault=FAULT, inform=INFORM, refund=REFUND, visit=VISIT, repair=REPAIR,
               explain=EXPLAIN, feature=FEATURE, severe=SEVERE, moderate=MODERATE,
               urgent=URGENT, repeat=REPEAT)
