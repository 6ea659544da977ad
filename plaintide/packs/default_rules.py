"""Default classification pack: word lists, ordered patterns and thresholds. Fixed values throughout.

The capture stages are in ``packs/capture.py``.
"""
from plaintide.packs.capture import CAPTURE, SIGNALS
from plaintide.packs.labels import EXPERIENCE, NON_ISSUE, PRODUCT, SERVICE

DENY = (
    "故障|异常|失灵|失效|坏了|无法|不能|黑屏|死机|卡顿|异响|抖动|漏|断|烧|烫|"
    "投诉|不满|抱怨|吐槽|不满意|失望|糟糕|太差|差|难用|"
    "诉求|维权|索赔|退款|退费|退订|退换|赔偿|"
    "推诿|敷衍|忽悠|欺骗|拖延|不理|没人理|没处理|未解决|未处理|没回复|"
    "建议|希望|期望|期待|增加|优化|改进|完善|提升|添加|"
    "售后|维修|保养|质保|备件|代步|进店检修|服务门店|回访|理赔|"
    "销售|销售顾问|顾问|门店|客服|接待|试驾|意向金|"
    "购车|下定|订单|展厅|价格|提车|交付|订金|定金|合同|发票|"
    "车机|中控屏|座舱|hud|屏幕|仪表|"
    "lfc|闪充|超充|地锁|公共充电|充电桩|充电枪|家充|"
    "智驾|领航|noa|aeb|泊车|ad4|辅助驾驶|"
    "钥匙|解锁|nfc|uwb|"
    "ota|升级失败|"
    "报警|告警|报错|警告|bug|警示|"
    "乱收费|加价|不退|不修|不换"
)
PRAISE = ("表扬|点赞|不错|给力|感谢|谢谢|多谢|好评|认可|夸赞|赞一个|"
          "满意|挺好|很好|很棒|超棒|靠谱|专业|贴心|高效|及时|推荐|五星|完美|nice")
NEUTRAL = "咨询|询问|请教|想了解|想问一下|想问|请问|问一下|问问|了解一下|了解下|了解|打听"


def rule(parts, l1, l2, l3, confidence, deny=""):
    return {"parts": parts, "l1": l1, "l2": l2, "l3": l3, "confidence": confidence, "deny": deny}


PRIORITY = [
    rule((r"^[\s　]*((很好|好|挺好|很棒|超棒|不错|可以|还行|还可以|没问题|没事|赞|满意|完美|nice|good|ok)"
          r"[\s　。！!\.\?\?,，~～]*)+$",), NON_ISSUE, "咨询与表扬", "短句好评", 0.88),
    rule((PRAISE,), NON_ISSUE, "咨询与表扬", "表扬感谢", 0.86, DENY),
    rule((NEUTRAL,), NON_ISSUE, "咨询与表扬", "纯咨询", 0.85, DENY),
    rule(("lfc|闪充站|超充|公共充电|充电站|地锁", "故障|异常|占位|打不开|扫不了|不可用|坏|破损|无法|不能"), PRODUCT, "LFC问题", "闪充站问题", 0.94),
    rule(("钥匙|数字钥匙|解锁|nfc|uwb", "故障|异常|失灵|失效|无法|不响应|配对失败|无法绑定|无法解锁|无法锁车"), PRODUCT, "钥匙问题", "钥匙-通用", 0.93),
    rule(("智驾|领航|noa|aeb|泊车|辅助驾驶|ad4", "故障|异常|失灵|退出|脱手|误触发|不工作|不识别|警报"), PRODUCT, "AD4问题", "智驾-通用", 0.92),
    rule(("座舱|车机|中控屏|hud|抬头显示|屏幕|仪表", "故障|异常|卡顿|黑屏|死机|失灵|花屏|重启|无响应|不亮"), PRODUCT, "座舱问题", "卡顿-通用-车机", 0.94),
    rule(("售后|维修|保养|质保|备件|代步|道路救援|售后慢|售后差|售后不理|售后糟|进店检修|服务门店|回访|理赔",), SERVICE, "售后服务问题", "服务体验不佳", 0.93),
    rule(("销售顾问|销售|购车|下定|订单|展厅|价格|意向金|试驾|顾问",), SERVICE, "销售服务问题", "销售服务-通用", 0.92),
    rule(("提车|交付|订金|定金|合同|置换|发票", "拖延|违约|纠纷|不退|延期|欺骗|跳票|没消息|久未交付"), SERVICE, "交付问题", "整车交付状态不良", 0.91),
    rule(("车机|座舱|中控屏|大连屏|仪表|屏幕", "卡|顿|黑|闪|花屏|死机|失灵|重启|无响应"), PRODUCT, "座舱问题", "卡顿-通用-车机", 0.93),
    rule(("hud|抬头显示|ar模式|ar 模式", "卡|顿|卡帧|掉帧|失灵"), PRODUCT, "座舱问题", "HUD屏异常问题", 0.95),
    rule(("卡帧|掉帧", "hud|抬头显示"), PRODUCT, "座舱问题", "HUD屏异常问题", 0.95),
    rule(("充电|闪充|快充|慢充|家充|桩|枪", "失败|异常|无法|充不进|充不了|断充|跳枪|报错"), PRODUCT, "车端充电问题", "无法充电", 0.93),
    rule(("lfc|闪充站|超充|充电站", "地锁|占位|打不开|坏|故障|扫不了"), PRODUCT, "LFC问题", "闪充站问题", 0.91),
    rule(("异响|抖动|漏油|漏水|故障灯|无法启动|失速|动力丢失",), PRODUCT, "故障-通用", "故障-通用-无明确载体", 0.89),
    rule(("ota.*蓝牙|蓝牙.*ota",), PRODUCT, "OTA更新问题", "OTA后蓝牙电话故障", 0.92),
    rule(("预约充电.*(无法|异常|失败|不准)|充电.*(预约|定时).*(问题|异常|失败)",), PRODUCT, "车端充电问题", "充电未按设定时间点开始或停止", 0.88),
    rule(("无法充电|充不进电|充电失败(?!.*建议)",), PRODUCT, "车端充电问题", "无法充电", 0.9),
    rule(("充电慢|充电功率低|充电.*慢",), PRODUCT, "车端充电问题", "车端充电-速度慢", 0.85),
    rule(("闪充站|超充站|地锁",), PRODUCT, "LFC问题", "闪充站问题", 0.88),
    rule(("家充桩|家用桩",), PRODUCT, "LFC问题", "家充桩问题", 0.88),
    rule(("(希望|建议|能否|能否考虑|最好加上)((?!(失败|异常|无法|坏了|故障)).)*(功能|导航|ui|界面|哨兵|座椅|音响|app)",),
         EXPERIENCE, "车机智能化", "车机智能化", 0.84),
    rule((f"(不是投诉|仅咨询|单纯咨询|只是问问|随便聊聊|纯属咨询)(?!.*({DENY}))",), NON_ISSUE, "咨询与表扬", "咨询", 0.86),
    rule((f"(五星好评|非常满意|特别满意|表扬一下|给你们点赞|非常感谢|十分感谢)(?!.*({DENY}))",), NON_ISSUE, "咨询与表扬", "表扬感谢", 0.85),
]

FAULT_WORDS = ("异响", "卡顿", "失灵", "断开", "失败", "异常", "报错", "无法", "漏", "烧", "烫", "抖")
FAULT_HINTS = ("卡帧", "掉帧", "黑屏", "死机", "亏电", "漏电", "车机", "智驾", "泊车", "雷达", "钥匙", "报警", "告警", "闪充", "lfc",
               "家充", "地锁", "hud", "抬头显示", "故障", "失灵", "座舱", "充电枪", "充电桩")
BROAD_PRODUCT = (
    "闪充", "超充", "地锁", "家充", "充电桩", "充电站", "充电枪", "占位", "ota", "ota", "车机",
    "气囊", "导航", "音响", "座椅", "天窗", "车门", "轮胎", "悬架", "雨刮", "雨刷", "后视镜",
    "灯光", "空调", "车窗", "蓝牙", "hud", "抬头显示", "智驾", "泊车", "雷达", "钥匙", "黑屏",
    "死机", "故障", "不亮", "坏了", "脱落", "泄漏", "断裂", "松动", "卡死", "电池", "电机",
    "充电", "内饰", "油漆", "生锈", "漏水", "电吸", "尾门", "后备箱", "前备箱", "减速", "助力")
NON_ISSUE_BOOST = ("不是投诉", "仅咨询", "单纯咨询", "只是问问", "随便聊聊", "闲聊", "五星好评", "非常满意", "特别满意", "表扬", "点赞",
                   "感谢你们", "谢谢你们的", "辛苦了", "咨询一下", "想了解一下", "请问一下", "纯属表扬")
NEGATIVE_NON_ISSUE = (
    "投诉", "不满意", "不满", "失望", "糟糕", "体验差", "难用", "崩溃", "心累", "无语", "气愤", "愤怒", "郁闷", "吐槽", "抱怨",
    "故障", "异常", "失灵", "失效", "坏了", "卡顿", "黑屏", "死机", "异响", "抖动",
    "漏水", "漏液", "漏电", "亏电", "断连", "重启", "无响应", "报错", "报警", "告警",
    "无法充电", "充不进", "充不了", "充电失败", "充电异常", "功能异常", "硬件问题",
    "售后差", "售后慢", "售后不理", "服务差", "态度差", "推诿", "敷衍", "忽悠", "欺骗",
    "拖延", "没人理", "无人处理", "没解决", "未解决", "未处理", "没回复", "无回复",
    "乱收费", "多收费", "加价", "不退", "不修", "不换",
    "诉求", "维权", "索赔", "退款", "退费", "退订", "退换", "赔偿", "希望官方", "希望尽快",
    "希望解决", "希望处理", "要求处理", "必须解决", "尽快处理", "尽快解决",
    "问题反馈", "反馈问题", "反映问题", "多次反映", "多次投诉", "多次沟通",
    "建议", "希望", "期望", "期待", "优化", "改进", "完善", "提升", "增加", "添加",
    "售后", "维修", "保养", "质保", "备件", "代步", "道路救援", "销售", "顾问", "门店", "客服", "接待", "试驾", "意向金",
    "交付", "提车", "订金", "定金", "合同", "发票", "车机", "中控屏", "座舱", "屏幕", "仪表", "hud", "抬头",
    "lfc", "闪充", "超充", "地锁", "公共充电", "充电桩", "充电枪", "家充",
    "智驾", "领航", "noa", "aeb", "泊车", "ad4", "辅助驾驶", "钥匙", "解锁", "nfc", "uwb", "ota", "升级失败")


def words(weight, items, **kw):
    return {"weight": weight, "words": items, **kw}


SLOW_SYSTEMS = ("充电", "车机", "系统", "升级", "OTA", "车速")
ODD_SERVICE = ("服务", "售后", "态度", "门店")
ODD_SYSTEMS = ("车机", "充电", "屏幕", "系统", "电池", "车辆")
SCORES = {
    "product": [words(6.0, FAULT_WORDS), words(2.5, FAULT_HINTS), words(4.0, ("故障", "不亮", "坏了", "脱落", "泄漏", "断裂", "松动")),
                words(1.85, BROAD_PRODUCT, lower=True), words(5.0, ("慢",), also=(SLOW_SYSTEMS,)),
                words(4.0, ("异常",), also=(ODD_SERVICE, ODD_SYSTEMS)), words(4.0, ("异常",), unless=ODD_SERVICE)],
    "service": [words(7.0, ("售后", "门店"), each=False), words(3.5, ("态度", "收费", "差")), words(3.0, ("慢",), unless=SLOW_SYSTEMS),
                words(2.5, ("投诉", "退款", "积分", "合同", "订金", "定金", "索赔", "代步", "保养", "质保", "维修", "备件", "销售", "万象城",
                            "交付", "提车", "客服")), words(4.0, ("异常",), also=(ODD_SERVICE,), unless=ODD_SYSTEMS)],
    "experience": [words(5.0, ("建议", "希望", "优化", "增加", "能不能", "想要"))],
    "none": [words(3.8, NON_ISSUE_BOOST, unless=NEGATIVE_NON_ISSUE)],
}


def to(target, weight, items, **kw):
    return {"target": target, "weight": weight, "words": items, **kw}


ROUTES = {
    PRODUCT: [
        to("Emira问题", 20, ("emira",), lower=True),
        to("LFC问题", 18, ("闪充", "超充", "地锁", "三方充电", "充电站", "公共充电")), to("LFC问题", 17, ("家充", "家用桩")),
        to("车端充电问题", 18, ("预约充电", "车端充电", "无法充电", "充不进", "充电失败", "充电功率", "充电慢", "充电中断", "波谷充电", "充电盖板")),
        to("AD4问题", 17, ("智驾", "领航", "NOA", "AEB", "泊车", "AD4", "流媒体", "AVM", "辅助驾驶")), to("异响问题", 18, ("异响", "异音")),
        to("钥匙问题", 15, ("钥匙", "解锁", "数字钥匙", "UWB", "nfc", "nfc卡")),
        to("座舱问题", 16, ("蓝牙", "HUD", "hud", "抬头显示", "车机", "导航", "CarPlay", "carplay", "语音", "音响", "CSD", "黑屏", "死机", "卡帧",
                        "掉帧", "屏幕", "仪表")),
        to("OTA更新问题", 16, ("ota",), lower=True, also=("故障", "蓝牙", "失败", "异常", "问题")), to("故障告警", 14, ("报警", "告警", "故障灯")),
        to("车门问题", 12, ("车门", "尾门", "电吸门")),
        to("电子电器问题", 14, ("空调", "激光雷达", "无线充电", "车窗", "雨刷", "后视镜", "灯光", "天窗", "电子电器")), to("APP问题", 12, ("APP", "应用", "小程序"))],
    SERVICE: [
        to("售后服务问题", 18, ("售后", "维修", "备件", "索赔", "保养", "质保", "代步", "道路救援")), to("销售服务问题", 17, ("销售", "门店", "政策", "顾问", "万象城")),
        to("订单取消/退款", 17, ("订单", "退款", "退订", "定金", "订金")), to("积分发放问题", 16, ("积分",)), to("交付问题", 14, ("交付", "提车")),
        to("车品商城问题", 12, ("商城", "车品", "周边"))],
    EXPERIENCE: [
        to("OTA建议", 18, ("ota", "升级"), lower=True), to("华为/安卓手机数字钥匙", 16, ("华为", "安卓", "数字钥匙", "手机钥匙", "三星", "魅族")),
        to("导航沿途规划权益充电", 12, ("充电地图", "导航", "沿途", "规划充电"))],
    NON_ISSUE: [
        to("咨询与表扬", 18, ("表扬", "感谢", "点赞", "好评", "满意", "五星", "非常棒"), unless=NEGATIVE_NON_ISSUE),
        to("咨询与表扬", 14, ("咨询", "问问", "了解", "请问", "想问", "问一下"), unless=NEGATIVE_NON_ISSUE)],
}
SYMPTOMS = [{"when_l1": PRODUCT, "words": w, "l1": PRODUCT, "l2": f"{n}-通用", "l3": f"{n}-通用-无明确载体", "confidence": 0.52} for w, n in (
    (("卡顿", "卡死"), "卡顿"), (("异响",), "异响"), (("黑屏",), "黑屏"), (("死机",), "死机"), (("故障", "失灵"), "故障"))]
WEAK = {"wish_words": ("优化", "建议", "希望", "想要", "能不能"), "experience": ("优化-通用", "优化-通用-无明确建议", 0.45),
        "service": ("售后服务问题", "通用", 0.40)}

CONFLICTS = [{"id": "C1", "when_l1": NON_ISSUE, "keyword_group": "negative"}, {"id": "C2", "when_l1": SERVICE, "keyword_group": "quality"},
             {"id": "C3", "when_l1": EXPERIENCE, "keyword_group": "quality"}]
CONFLICT_GROUPS = {
    "negative": ("投诉", "赔偿", "退款", "售后", "故障", "维修", "不能用", "无法使用", "无法启动", "无法开机", "坏了", "死机", "黑屏", "起火", "自燃", "爆炸",
                 "漏液", "断货", "无货", "缺陷", "质量问题", "召回", "危险", "不安全", "换车", "退车", "不满意", "失望", "愤怒", "气愤", "耽误", "延迟",
                 "超时", "拖延", "敷衍", "忽悠", "欺骗", "套路", "霸王", "刁难", "傲慢", "推诿", "忽视", "无视", "不理", "不管", "不解决", "不处理",
                 "不回应", "不答复", "严重", "强烈", "抗议", "要求"),
    "quality": ("电池", "续航", "掉电", "断电", "动力", "电机", "刹车", "方向盘", "轮胎", "底盘", "车机", "中控", "大屏", "仪表", "空调", "座椅", "车门",
                "车窗", "后备箱", "尾门", "引擎", "发动机", "变速", "变速箱", "齿轮", "传感器", "雷达", "摄像头", "碰撞", "追尾", "侧滑", "失控", "抖动",
                "异响", "漏水", "漏油", "渗水", "漏气", "起火", "自燃", "趴窝", "抛锚", "无法充电", "充不进", "充电桩", "充电口", "快充", "慢充", "超充",
                "换电站", "电池包", "电芯", "电控", "电压", "续航缩水", "续航虚标", "严重故障", "质量缺陷", "工艺缺陷", "安全隐患", "卡死", "花屏", "失灵",
                "失效"),
}
NEGATIVE = SIGNALS["hard_negative"]
RELOCATE = [
    ("售后|维修|保养|质保|备件|代步|道路救援|售后慢|售后差|进店检修|服务门店|回访|理赔", SERVICE, "售后服务问题"),
    ("销售|销售顾问|顾问|门店|客服|接待|试驾|意向金|购车|下定|订单|展厅|价格", SERVICE, "销售服务问题"),
    ("交付|提车|订金|定金|合同|发票|延期交付", SERVICE, "交付问题"),
    ("车机|中控屏|座舱|hud|抬头|屏幕|仪表", PRODUCT, "座舱问题"),
    ("lfc|闪充站|超充|地锁|公共充电", PRODUCT, "LFC问题"),
    ("充电|快充|慢充|家充|充电桩|充电枪", PRODUCT, "车端充电问题"),
    ("钥匙|解锁|nfc|uwb", PRODUCT, "钥匙问题"),
    ("智驾|领航|noa|aeb|泊车|ad4|辅助驾驶", PRODUCT, "AD4问题"),
    ("异响", PRODUCT, "异响问题"),
    ("建议|希望|期望|增加|优化|改进|完善", EXPERIENCE, "OTA建议"),
]
DOMAIN = SIGNALS["lfc_charging_domain"]
DOMAIN_COMPLAINT = SIGNALS["lfc_charging_complaint"]
DOMAIN_CONSULT = SIGNALS["lfc_charging_consult"]
SERVICE_ISSUE = SIGNALS["srv_quality_issue"]
DOMAIN_L2 = {
    "vehicle_l2": "车端充电问题", "station_l2": "LFC问题",
    "vehicle_side": r"充电功率低|功率只有|功率过低|预约充电.{0,10}(不充电|未充电|没有开始)|车辆.{0,8}(充不进|无法充电)|车端充电",
    "supplier": r"蔚来|浩瀚|第三方桩|供应商|桩下线", "inquiry": r"(?:询问|咨询|修好了|什么时候|维修完成|需要回复|催促|告知|回复)",
    "strong_fault": r"下线|故障|损坏|占位费|地锁",
    "station_fault": r"(?:充电桩|充电站|闪充站|超充站|极充站).{0,12}(?:下线|故障|损坏|不可用|不能使用|无法使用)|占位费|地锁",
    "station": r"闪充站|超充站|极充站|充电站"}
FAULT_HINT = r"(故障|坏了|无法|异常|黑屏|死机|异响|撞|碰撞|失灵|充不进|跳枪|没.{0,6}音乐|信号差|迟钝|下载安装)"
GUARD = {
    "signals": {
        "issue": NEGATIVE + "|建议|亏电|漏电|质量问题", "negative": NEGATIVE,
        "exempt": r"(续航|电耗|里程).{0,24}(是否正常|正常吗|询问|咨询)|询问是否正常",
        "product_tilt": (r"(车机|中控屏|座舱|充电|[闪超]充|充电桩|充电枪|地锁|电池|电机|异响|黑屏|死机|故障灯|雷达|激光雷达|钥匙|软件|ota|底盘|车门|轮胎|气囊|空调|尾门|"
                         r"漏水|漏油|辅助驾驶|智驾|自动驾驶|流媒体|信号|唤醒|小蓝灯|音乐|网易云)"),
        "service_tilt": (r"(售后|门店|交付|销售|顾问|客服|接待|4s|提车|订金|定金|合同|积分|保养|维修工单|服务态度|推诿|回访|服务站|交车|生产太慢|权益不相同)"),
        "experience_tilt": (r"(希望|建议|能否|最好|意见).{0,48}(便宜|六座|复杂|路况|浮动歌词|歌词|手动关闭|升级改进|出.{0,8}车|商城|配件|陈列|"
                            r"OTA|功能|智驾|自动|语音|导航|后备箱|尾门)"),
        "fault": FAULT_HINT, "wish": r"(建议|希望|能否|最好|增加|优化|多出|加上)", "service_word": r"(交付|销售|回访|下定|提车|积分|门店|顾问)",
        "domain": DOMAIN, "domain_complaint": DOMAIN_COMPLAINT, "domain_consult": DOMAIN_CONSULT, "service_issue": SERVICE_ISSUE,
        "station_inquiry": DOMAIN_L2["inquiry"], "station": DOMAIN_L2["station"], "supplier": DOMAIN_L2["supplier"],
        "vehicle_dominant": r"担心车辆|车辆问题|到售后|售后检查|充一会|停止充电|再次启动|几分钟后",
        "context_block": (r"还没人添加|还没.{0,10}添加微信|目前还没人|为其反馈催促|异响|还没解决|代步车|滴滴打车|检查\d次|上门检查\d次|"
                          r"售后回访.{0,400}(?:掉线|不显示|有问题|检测|仪表|更换|额外)|提示.{0,12}保养|保养.{0,12}(?:提示|是什么情况|什么情况)|"
                          r"弄脏|翻在|风油精|之前有反馈|此前有反馈|之前.{0,8}反馈过|烧蚀|钥匙失效|数字钥匙失效|感应不上|卡片钥匙|安排取车|取车保养"),
        "coordination": (r"联系对接|门店对接|需要对接|需要联系|需要门店|催促.{0,10}确认|是否可以|能否|询问.{0,12}(?:积分提醒|有多少数额|大概有多少)|"
                         r"什么时候.{0,15}(?:进店|贴膜|安装)|改到.{0,10}(?:上门|服务|星期)|需要.{0,6}(?:救援|做个保养)|协助安装|"
                         r"(?:活动|服务活动).{0,40}(?:到位|耐心解答|耐心沟通)|还是挺到位|看一看(?:FORME|forme)|前往.{0,8}门店.{0,12}(?:清洗|补能|看看)"),
        "coordination_block": (r"投诉|不满|态度差|无人响应|无法联系|未处理|乱收费|收费不合理|保养后|故障|异常|无法启动|黑屏|失灵|质量问题|受伤|"
                               r"为什么还没|过了这么久|这么久|为什么还|为什么不|索赔|路政|胜诉|要求安排上门|上门处理|再次致电|移动上门|"
                               r"三角钥匙|钥匙无法|钥匙坏|没人联系|无人联系|空号|显示空号|联系不上|被扣除|前后说法|不一致|核实下|"
                               r"组织外部|IT安全|没人接听|无人接听|异响|还没解决|代步车|滴滴打车|还没人添加|还没.{0,10}添加微信|目前还没人"),
        "coordination_place": r"充电站|闪充站|充电桩|换桩", "coordination_push": r"催促|上线|什么时候|联系我",
        "roadside": r"爆胎|扎钉|补胎|瘪胎|换胎|轮胎没气|胎压|道路救援|拖车|需要救援|需要拖车",
        "maintenance": r"预约保养|预约.{0,8}保养|需要.{0,6}保养|需要做个保养|常规保养",
        "roadside_block": (r"投诉|不满|态度差|无人响应|无法联系|未处理|乱收费|收费不合理|维修失败|保养后|故障|异常|无法启动|黑屏|失灵|质量问题|受伤|"
                           r"报价|定损|索赔|为什么还没|过了这么久|没人接听|无人接听|没人联系|无人联系|空号|显示空号|联系不上|三角钥匙|钥匙无法|钥匙坏|再次致电"),
        "aftersales": r"售后.{0,12}(?:对接|支持|联系|协助)|维修需求.{0,16}(?:对接|联系|协助)|需要.{0,8}售后.{0,12}(?:支持|对接|联系|协助)",
        "aftersales_block": r"投诉|不满|没人接听|无人接听|不接听|收费不合理|无人响应",
        "unanswered": r"没人接听|无人接听|不接听", "pickup": r"人过来取车|上门取车|取车吗|取送车|安排取车|取车保养",
        "station_words": r"充电桩|充电站|闪充站|换桩|什么时候", "release_words": r"【\d+\.\d+|OTA|哨兵模式|时光引擎|车道级导航",
        "assist": (r"爆胎|扎钉|补胎|瘪胎|换胎|轮胎没气|胎压|交通事故|发生事故|道路救援|拖车|保养|到店检测|到店检查|预约检测|预约检查|有什么问题|怎么回事|"
                   r"积分|贴膜|车膜|ETC|代驾|清洗|补能|客档|权益|商城|赠品|邮寄|维修单|移动上门|对接|活动|看一看"),
        "assist_intent": (r"咨询|询问|需要预约|需要协助|需要安排|需要移动|需要到店|需要救援|需要对接|需要联系|需要做个保养|需要拖车|需要补胎|"
                          r"协助|安排|预约|上门|如何处理|怎么办|求助|售后支持|催促|是否可以|能否|什么时候|改到"),
        "explicit_issue": (r"投诉|不满|态度差|无人响应|无法联系|未处理|乱收费|收费不合理|维修失败|保养后|故障|异常|无法启动|黑屏|失灵|质量问题|受伤|"
                           r"报价|定损|剐蹭|损伤|维修|套餐|门店表示|去了门店|没人联系|无人联系|没人接听|无人接听|空号|显示空号|联系不上|"
                           r"为什么还没|过了这么久|这么久|为什么还|为什么不|索赔|路政|胜诉|无法使用|不能用|坏了|要求安排上门|上门处理|"
                           r"付费吗|会收费|为什么不显示|三角钥匙|钥匙无法|钥匙坏|再次致电|移动上门|被扣除|前后说法|不一致|核实下|什么情况"),
        "story": r"分享|自驾|游记|旅途|旅程|一路|风景|日常用车|提车日记|打卡",
        "demand": r"投诉|建议|希望|要求|故障|异常|无法|不能|黑屏|死机|异响|报错|失灵|维修|后备箱|收纳|储物|配件|改装|安装|套餐"},
    "service_l2": [("售后回访", "售后服务问题"), ("交付回访", "交付问题"), ("销售回访|试驾回访", "销售服务问题"), ("试驾|销售", "销售服务问题"), ("交付", "交付问题")],
    "service_l2_default": "售后服务问题",
    "product_l2": [(r"充电|[闪超]充|家充|桩|地锁|跳枪", "车端充电问题"), ("车机|座舱|屏幕|hud|抬头|中控屏", "座舱问题"), ("异响", "异响问题")],
    "product_l2_default": "故障-通用", "experience_l2_default": "OTA建议", "story_source": "app|应用",
    "context_keep": {EXPERIENCE: ("车机智能化", "充电建议", "OTA建议", "智驾建议", "智驾系统", "智驾功能"), PRODUCT: ("故障告警",), SERVICE: ("钥匙问题",)},
    # (class, its L2 or any filled one, signal of the text): kept as it is.
    "context_keep_if": ((EXPERIENCE, None, "release_words"), (PRODUCT, ("LFC问题",), "station_words"),
                        (SERVICE, ("交付问题", "售后服务问题", "销售服务问题", "试驾体验不良"), "unanswered"),
                        (SERVICE, ("交付问题", "售后服务问题", "销售服务问题", "试驾体验不良"), "pickup")),
}
FACILITIES = ("超充站", "闪充站", "充电桩", "充电枪", "充电模块", "充电站", "家充桩", "家用充电桩", "超充", "闪充", "快充", "慢充", "充电设施", "充电设备")
TRIGGERS = ("故障", "无法", "不能", "不能用", "不工作", "坏", "损坏", "有问题", "问题", "质量差", "安装问题", "安装质量差", "无法充电", "充不进", "充不进电",
            "不充电", "断电", "异常")
FEED_CLASSES = ("产品质量问题", "销售服务问题", "产品咨询", "体验需求", "非问题")
# (class, weight per word, words); the order breaks ties.
WEIGHTS = [
    ("产品质量问题", 10, ("故障", "异响", "死机", "黑屏", "卡顿", "抖动", "漏电", "漏水", "漏油", "熄火", "无法启动", "启动不了", "启动失败", "打不着",
                    "刹车失灵", "充电慢", "充不进", "充电中断", "充电失败", "续航虚标", "续航缩水", "掉电快", "空调不制冷", "空调不制热", "自燃", "起火", "冒烟",
                    "过热", "失控", "安全隐患", "质量问题", "品质问题", "缺陷", "瑕疵", "损坏", "破损", "充电不能用", "维修质量差", "安装问题", "工艺缺陷")),
    ("销售服务问题", 5, ("服务态度", "态度差", "态度恶劣", "不耐烦", "不专业", "不靠谱", "不负责", "推诿", "踢皮球", "等待", "等太久", "交付延迟", "延期交付", "不退订金",
                   "不退定金", "退款", "退费", "虚假宣传", "欺骗", "隐瞒", "合同纠纷", "霸王条款", "乱收费", "收费不合理", "理赔", "投诉", "处理慢", "效率低", "服务",
                   "销售", "售后", "经销商", "4s店", "门店")),
    ("体验需求", 8, ("希望", "建议", "提议", "增加", "优化", "改进", "提升", "改善", "完善", "更新", "升级", "添加", "开发")),
    ("产品咨询", 3, ("能不能", "是否可以", "能否", "可不可以", "怎么", "如何", "怎么样", "怎样", "多少", "价格", "费用", "报价", "配置", "参数", "续航", "电池", "充电",
                 "尺寸", "空间", "颜色", "内饰", "预订", "提车时间", "有没有", "分期", "贷款", "保险", "区别", "对比", "什么时候", "哪里", "咨询", "询问", "了解",
                 "想知道", "请问")),
]
VOTE = [
    ("产品质量问题", ("故障", "异响", "死机", "黑屏", "卡顿", "抖动", "漏电", "漏水", "熄火", "失控", "自燃", "刹车", "充电", "续航", "电池", "电机", "车机", "屏幕")),
    ("销售服务问题", ("服务", "销售", "售后", "态度", "等待", "交付", "投诉", "理赔", "退款", "虚假", "承诺", "推诿", "4s店", "经销商")),
    ("产品咨询", ("价格", "配置", "多少", "怎么", "如何", "能否", "可以", "续航", "电池", "充电", "参数", "尺寸", "空间", "颜色")),
    ("体验需求", ("希望", "建议", "增加", "优化", "改进", "提升", "改善", "完善", "更新", "升级", "添加", "功能", "体验", "希望能有")),
    ("非问题", ("感谢", "谢谢", "表扬", "满意", "好评", "推荐", "赞", "喜欢", "开心", "满意", "不错", "给力")),
]
BOUNDARY = {
    "fault": ("故障", "异响", "死机", "黑屏", "卡顿", "自燃", "起火", "失控", "刹车失灵", "漏电", "漏水", "漏油", "熄火", "无法启动", "打不着", "报警", "充不进", "充不了",
              "无法充电", "不能充电", "充电故障", "电机故障", "电池故障", "充电桩故障", "超充站故障", "闪充站故障"),
    "non_issue": ("感谢", "谢谢", "好评", "满意", "表扬", "赞", "推荐", "认可"),
    "suggest": ("建议", "希望", "期待", "优化", "改进", "提升", "完善", "增加", "添加"),
    "service": ("售后", "服务", "门店", "交付", "客服", "流程", "网点", "保养"),
    "boundary": (("fault", "产品质量问题", "含故障词"), ("non_issue", "非问题", "含非问题词"), ("suggest", "体验需求", "含建议词且无故障"),
                 ("service", "销售服务问题", "含服务词且无故障")),
    "mixed": (("体验需求", ("故障", "异响", "死机", "黑屏", "卡顿", "问题", "损坏", "质量"), "体验需求+故障"),
              ("销售服务问题", ("故障", "异响", "死机", "黑屏", "卡顿", "问题", "损坏", "质量"), "销售服务+故障"),
              ("产品质量问题", ("建议", "希望", "优化", "提升", "增加", "改进", "完善"), "产品质量+建议")),
}
# A small taxonomy in the usual shape: (l1, l2, l3, frequency).
TAXONOMY = [
    (PRODUCT, "座舱问题", "卡顿-通用-车机", 40), (PRODUCT, "座舱问题", "HUD屏异常问题", 12), (PRODUCT, "座舱问题", "通用", 5),
    (PRODUCT, "车端充电问题", "无法充电", 33), (PRODUCT, "车端充电问题", "车端充电-速度慢", 9), (PRODUCT, "LFC问题", "闪充站问题", 28),
    (PRODUCT, "LFC问题", "家充桩问题", 11), (PRODUCT, "钥匙问题", "钥匙-通用", 14), (PRODUCT, "故障-通用", "故障-通用-无明确载体", 20),
    (SERVICE, "售后服务问题", "服务体验不佳", 30), (SERVICE, "售后服务问题", "通用", 6), (SERVICE, "销售服务问题", "销售服务-通用", 22),
    (SERVICE, "交付问题", "整车交付状态不良", 10), (EXPERIENCE, "OTA建议", "升级建议", 9), (EXPERIENCE, "车机智能化", "车机智能化", 8),
    (NON_ISSUE, "咨询与表扬", "表扬感谢", 18), (NON_ISSUE, "咨询与表扬", "纯咨询", 16), (NON_ISSUE, "其他非问题", "通用", 3)]
L2_ALIASES = {"咨询表扬": "咨询与表扬", "咨询": "咨询与表扬", "其他": "其他非问题", "其他非问题类": "其他非问题", "故障通用": "故障-通用", "故障": "故障-通用"}

PACK = dict(priority=PRIORITY, scores=SCORES, routes=ROUTES, route_default={NON_ISSUE: "其他非问题"}, symptoms=SYMPTOMS, weak=WEAK, conflicts=CONFLICTS,
            conflict_groups=CONFLICT_GROUPS, negative=NEGATIVE, consult_l2="咨询与表扬", relocate=RELOCATE, relocate_default=(PRODUCT, "故障-通用"),
            capture=CAPTURE, domain_l2=DOMAIN_L2, guard=GUARD, facilities=FACILITIES, triggers=TRIGGERS,
            weights=WEIGHTS, non_issue=("表扬", "感谢", "好评", "无故障", "没问题"), non_issue_negations=("不是非问题", "不算非问题"),
            boundary_words=BOUNDARY, boundary=BOUNDARY["boundary"], mixed=BOUNDARY["mixed"])
