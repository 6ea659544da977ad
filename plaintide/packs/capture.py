"""Which texts count as plain praise, question or notice: the default pack's decision list.

``SIGNALS`` are patterns that are looked for once per text; the other tables only combine them. A term is a signal's name,
("all", ...), ("any", ...), ("not", term) or ("max", n, term): at most n characters without white space.
"""
from __future__ import annotations

# Fixed values throughout: patterns and their names, and the lengths and codes below.
SIGNALS = {
    "mall_product_complaint": r"商城.{0,120}(?:晃动|间隙|支架|配件|缺少|质量问题)|支架.{0,60}(?:晃动|间隙)",
    "community_chatter": r"(不懂就问！|顺便看看各位|斯皮尔伯格入镜|申请加精|纯个人喜好|forme黑武士提车|这个绿牌|太好了\s*是?\s*ota|我们有救了)",
    "business_issue_guard": (
        r"(?s)(积分.{0,48}(只|少|未|不对|一个渠道|核实|未收到|没到账)|未按阶梯奖励|阶梯奖励|权益膨胀积分|活动积分还未收到|催促.{0,12}礼盒|"
        r"交付礼包.{0,24}没有|车模也没有下文|有划痕.{0,16}需要处理|需要退.{0,8}需要换|不支持换货|单方事故|协调拖车|拖至门店维修|服务态度.{0,8}(差|"
        r"非常差)|被挂断.{0,24}(生气|很生气)|损坏.{0,36}(报价|等待.{0,10}小时|主动询问)|又没.{0,8}到账|没有收到.{0,16}(尾款|定金|支付|"
        r"45w)|又被下线|搜索不到了|需要重新上线|处理时效太长|不能以质保|自费处理后才能|有更换的痕迹|空调不制冷|门打不开|里面也打不开|橡胶条掉渣|快撞上|极速转向|"
        r"突然.{0,8}急刹|洗车服务需要加强|水渍都不擦|太难吃了|权益.*什么时候发放|询问先启积分催促|报价.{0,20}差异|对齐工作.{0,20}差异|"
        r"定金.{0,24}未退回|工作日还未到|延迟的原因|等所需的零件|已经在.{0,16}两个月)"),
    "delivery_complaint": (
        r"(?s)((销售|售后)回访|客户打的是五星|评价五星).{0,160}(流程太长|等待时间久|等待久|还未交付|交付可以快|没有提交按钮|意见建议|从下定到交车|太寒酸|"
        r"寒酸|拍不出|拍不出来|太简陋)|((试驾|交付)回访).{0,200}(太寒酸|寒酸|拍不出|拍不出来|太简陋|无人联系|没有联系)|"
        r"想给5星好评获取积分.{0,32}没有提交按钮|5星好评获取积分.{0,24}没有提交按钮|希望交付可以快一点"),
    "symptom_inquiry": (
        r"(?s)(这正常吗|是否正常|正常吗|不准确|显示不对|找不到.{0,12}功能|没有找到对应|无法使用|不能使用|发不出|怎么发送图片|怎么附上图片|附上图片|坑坑洼洼|"
        r"什么原因造成|想了解.{0,12}原因|可以进店检查|想了解是什么原因|智驾.{0,32}(退出|撞|急刹)|闷响|自动泊车.{0,20}(不了|不能用)|行程显示.*不准确|"
        r"只有一个人服务|接待只有一个人|车辆在.{0,24}(有一段时间|两个月)|还在等待所需的零件|咨询自己车辆的OTA进度|后扰流板损坏|扰流板损坏.{0,16}需要更换|"
        r"连接.{0,8}应用程序|找不到任何地方的选项)"),
    "v12_service_pullback": (
        r"(?s)((用户反馈|客户反馈|用户表示|客户表示).{0,160}(核实|催促|催办|什么时候|进度|对接|扣除|不一致|纠纷|未收到|没收到|还未|怎么办|什么情况|"
        r"怎么回事|前后说法|投诉|不满|态度|等待|延迟|维修|保养|交付|售后|门店|订金|定金|尾款|积分|联系不上|无人接听))"),
    "v12_product_pullback": (
        r"(?s)((用户反馈|客户反馈|用户表示).{0,120}(异响|黑屏|死机|失灵|无法|不能|故障|报警|告警|坏了|漏|卡顿|抖动|损坏|不制冷|打不开|断连|充不进|"
        r"充不了|跳枪|提示错误|解错|扫码提示|信号差|迟钝|ota|升级后))"),
    "v12_experience_pullback": (
        r"(?s)((用户反馈|反馈|希望|建议|意见反馈).{0,80}(功能|软件|车机|智驾|自动泊车|语音|导航|辅助驾驶|后备箱|尾门|歌词|网易云).{0,80}(不能|"
        r"无法|异常|失灵|改进|优化|增加|不好用|难用|升级|关闭))"),
    "v12_followup_negative": (
        r"(?s)((试驾|交付)回访|客户评价[三四五]星|评价[三四五]星|评级星级).{0,220}(太|很|不|差|寒酸|简陋|慢|久|不满意|问题|投诉|拍不出|无建议|"
        r"无人联系|没有联系|没有回复|拍不出来|等待|还未|寒|太简陋)"),
    "v12_mixed_praise_issue": (
        r"(?s)((感谢|谢谢|满意|好评|点赞|五星|四星|三星).{0,120}(但是|不过|然而|却|问题|不满|差|慢|还未|没有|希望|要求|投诉|寒|太|拍不出|无建议|"
        r"寒酸|简陋))"),
    "v12_issue_with_praise": r"(?s)((问题|不满|差|慢|投诉|还未|没有|寒酸|拍不出|无人联系|太).{0,120}(感谢|谢谢|满意|好评|点赞|五星|四星|三星))",
    "v12_query_as_issue": (
        r"(?s)((咨询|询问|请问|想了解).{0,100}(故障|坏了|无法|不能|异响|核实|扣除|纠纷|维修|保养|交付|进度|怎么回事|需不需要|是不是坏|卡住|跳闸|解错|"
        r"进店检|制动|改到|改约|到店|没有人联系|无人联系)|(用户反馈|客户反馈).{0,80}(故障|核实|扣除|纠纷|维修|保养|交付|改到|改约|到店|没有人联系|无人联系|"
        r"制动))"),
    "v12_statement_issue": (
        r"(?s)((来电手机号|下定|用户表示|客户反馈|尾款|顾问咨询).{0,120}(不能|无法|未接|POS|POS机|POSS机|没有人联系|一直没有人|指标问题|改到|"
        r"改约|太寒酸))"),
    "v12_neutral_query_pullback": (
        r"(?s)((咨询|询问|请问|想了解).{0,120}(什么时候交付|交付时间|交付进度|如何处理|投诉|不满|怎么回事|为什么没有|为何没有|无人联系|没有人联系|什么情况|"
        r"前后说法不一致))|((用户|客户).{0,40}(反馈|表示|告知).{0,120}(咨询|询问).{0,120}(积分|订金|尾款|权益|交付).{0,80}(扣除|"
        r"不一致|不满|投诉|核实|怎么回事|为什么|无人联系))"),
    "hard_negative": (
        r"(故障|异常|失灵|失效|坏了|无法|不能用|不能充|充不进|充不了|黑屏|死机|卡顿|异响|抖动|漏液|漏水|漏油|断连|烧|(?<![滚])烫(?!金|印)|投诉|不满意|"
        r"抱怨|吐槽|失望|糟糕|太差|很差|服务差|态度差|售后差|售后慢|售后不靠谱|难用|诉求|维权|索赔|退款|退费|退订|退换|赔偿|推诿|敷衍|忽悠|欺骗|被坑|被骗|"
        r"被忽悠|被推诿|拖延|拖了|不理|没人理|没处理|未处理|未解决|没解决|没回复|无回复|无人处理|问题反馈|反馈问题|反映问题|希望解决|希望处理|希望改善|要求处理|"
        r"希望尽快解决|希望尽快处理|希望尽快回复|希望尽快修好|希望尽快弄好|必须解决|尽快解决|不给解决|多次反映|多次投诉|难受|郁闷|气愤|愤怒|无语|崩溃|心累|失望透顶|"
        r"无奈|扣分|扣钱|乱收费|多收费|加价|不退|不换|不修|报警|告警|报错|bug|警告|提示错误|售后糟|品控差|工艺差|做工差|品质瑕疵|希望官方|请尽快|强烈要求|"
        r"要求退换)"),
    "resolved_issue_praise": (
        r"(?s)(?:故障|报警|告警|胎压报警|坏了|爆胎|损坏|蹭了|糟心|异响|扎钉|刮蹭|小问题|问题).{0,280}(?:五星|好评|点赞|感谢|专业|靠谱|值得信赖|"
        r"必须给|强推|也太香了|满分|谁懂啊|极致专业|服务态度也超贴心|深表感谢|为.*点赞|满意|处理及时|服务很好|服务不错)"),
    "hard_negative_praise_override": (
        r"(?s)(因你们而滚烫|原地崩溃.{0,100}(也太香了|谁懂啊|太贴心了|移动上门|补胎)|(评价五星|客户评价五星|客户评价[三四五]星).{0,120}(还是很好|"
        r"整体还是很好|满意|不错)|体验真的满分|产品好感度.[45]星|人员服务意识.[45]星|不要太(好|棒|好看).{0,60}(谁懂啊|香了|爱了))"),
    "facility_service_request": r"(场地卫生|有蟑螂|尽快处理下场地|反馈.{0,24}闪充站有)",
    "service_inspection_request": r"(需要进店检查|想要进店检查|需不需要去补胎|是不是坏的|需要做车主认证|没有做车主认证|没人联系.{0,20}安装|再次来电催促)",
    "mixed_satisfaction": r"(?s)非常满意.{0,120}(无法体会|不过有个情况|整体还是|但总体)|(整体|总体).{0,40}(满意|不错|很好|认可)|满意.{0,60}(小问题|小遗憾|略微)",
    "testdrive_high_rating": r"(?s)(试驾回访|评级星级).{0,240}(产品好感度.[45]星|人员服务意识.[45]星)",
    "survey_high_rating": (
        r"(?s)((试驾回访|销售回访|客户评价|评价星级|评级星级).{0,320}(产品好感度|人员服务|服务意识|整体).{0,12}[45]星|"
        r"[四五]星.{0,160}(满意|很好|不错|认可|体验好|整体还是很好))"),
    "negation_before_positive": r"(不|没|未|无|(?<![特])别(?![人特])|并非|不是很|不太|不够|缺少)(?:太|很|太)?(?:好|棒|满意|喜欢|开心|愉快|舒服|专业|耐心|认可|赞)",
    "exaggerated_praise": r"不要太(好|棒|好看|爱了|惊艳|香了)",
    "lfc_charging_domain": (
        r"(lfc|极充|超充|闪充|家充|充电站|充站|充电桩|充电枪|占位费|超时占位|充电功率|功率只有|跳枪|地锁|异位充电|公共充电|自动闪充|家充桩|充桩|电缆米数|充完电|"
        r"驶离|闪充站|超充站|极充站)"),
    "lfc_charging_complaint": (
        r"(不认可|投诉|跳枪|充不进|充不了|无法充|不能充|充不上|充不进|功率只有|功率低|功率不足|功率异常|充电慢|充得慢|太慢|地锁无|无下一步|无反应|故障|坏了|异常|"
        r"占位费.{0,8}(贵|高|不合理|不该|投诉|多收)|超时占位|占位费不认可|扣费|多扣|烧|(?<![滚])烫(?!金|印))"),
    "lfc_charging_consult": (
        r"(咨询|询问|请问|问一下|想了解|了解一下|了解|打听|什么时候|何时|多久|到货|安装|价格|费用|有没有|是否有|能否|是否可以|怎么|如何|想知道|问问|是否支持|"
        r"能不能|购买|需要购买|想买|迁移家充|家充桩套保|自费购买|报装|电表|勘测|安装进度|开通|激活|绑定|申请|使用说明|操作流程|权益|免费)"),
    "lfc_question_tone": r"[?？]|吗|呢",
    "srv_quality_issue": r"(讲解少|体验不良|试驾体验不良|回访.*少|不良|不满意|不认可|还没.*了解的多|多次催促|再次催促)",
    "short_intent": r"^[\s\u3000]*(期待|期待已久)[\s\u3000。！!~～]*$",
    "short_benign": (
        r"^[\s\u3000]*((很好|好|挺好|很棒|超棒|不错|可以|还行|还可以|没问题|没事|赞|满意|完美|nice|good|"
        r"ok)[\s\u3000。！!\.\?\?,，~～]*)+$"),
    "weak_benign": (
        r"(已知晓|知悉|了解了|知道了|知晓了|已知悉|收到|无异议|无意见|无诉求|已回复|已沟通|已联系|已告知|已解释|已说明|好的收到|好的，收到|可以收到|嗯好的|嗯，好的|"
        r"正常|暂无疑问|无进一步|配合|同意|确认|知道了谢谢)"),
    "interest_intent": (
        r"(有意向|想购买|欲购买|考虑购买|打算买|准备买|有购买计划|想下订|想下定|想要订购|在关注|准备下单|计划购买|需要购买|购买家充|家充桩套保|迁移家充|期待已久|"
        r"攒了很久的期待|有兴趣购买|期待着您的联系|期待您的联系)"),
    "feedback_service_need": r"(用户反馈需要|反馈需要|需要取送|上门保养|需要保养|没有收到交付礼|需要售后报价|尽快.{0,10}联系)",
    "damage_inquiry": (
        r"(需要售后报价|需要报价|想要联系.{0,16}售后|需要换一套|磨得差不多|需要换胎|被剐蹭.{0,24}报价|后视镜.{0,8}擦碰|下护板刮伤|需要做车主认证|"
        r"没有做车主认证|想要进店检查|需要进店检查|需不需要去补胎|是不是坏的|没人联系.{0,20}安装|再次来电催促)"),
    "soft_suggestion": r"(客户建议|建议商城|加长一下|希望有更多的|怎么开启|大家都怎么解决|速度不够快啊|还可以再升级)",
    "ota_hype_praise": r"(太好了\s*是?\s*ota|我们有救了)",
    "wish_feedback": r"(来源[:：]?\s*意见反馈|意见反馈[，,].+|多点.{0,20}(配件|forme|FORME))",
    "price_inquiry": r"(费用多少|多少钱|价格多少|怎么收费|收费标准|更换.{0,16}费用)",
    "assist_coordination": r"(扎钉.{0,32}协助|需要协助处理|协助处理|(发生|发生了)碰撞.{0,36}需要协助|碰撞.{0,24}协助)",
    "soft_experience_share": r"(驾驶乐趣有|.{0,48}还欠缺|.{0,48}还(?:不够|不足))",
    "relay_benign": (
        r"(?s)((客户表示|用户表示|客户称|用户称).{0,120}(满意|认可|同意|配合|无意见|没问题|知晓|收到)|(门店|中心|建议).{0,100}(客户要求|"
        r"延长.{0,12}租车|继续维修)|RSA.{0,120}(请提供反馈|维修何时完成|是否需要延期))"),
    "soft_hope_suggest": r"(希望.{0,24}(优化|改进|完善|增加|升级|开放|上架|调整)|建议.{0,24}(商城|官方|增加|优化|延长|多点))",
    "v98_capture_block": r"(退货|退款|退订|沮丧|非常差|投诉|维权|索赔|支付保费|召回了一个多月|持续存在.{0,16}问题|单方事故)",
    "account_admin": r"(变更手机号|更换手机号|修改手机号|协助.*修改手机号|致电协助用户操作|保留车辆权益|变更车主信息|车主信息变更)",
    "want_arrange": r"(想要配.{0,16}(钥匙|卡片)|想要门店上门|想要.{0,12}上门)",
    "workslot_inquiry": r"(有空闲工位|空闲工位|有没有工位|工位吗)",
    "followup_contact": r"(再次进线|联系不上|电话没人接|之前.{0,20}对接过)",
    "delivery_schedule": r"(下定后交付时间|交付时间|什么时候交付|何时交付)",
    "mild_part_note": r"(掉出来.{0,16}螺母|包裹里没有|没有背带|缺.{0,10}绳子|自带塑料的垫片)",
    "advice_ask": r"(想知道.{0,64}建议|更换轮胎.{0,32}建议)",
    "minor_howto": r"((没有完全|无法).{0,24}如何解决|如何解决.{0,48}(提车的时候|就是这样子|一直这样))",
    "collision_assist": r"((发生|发生了)碰撞.{0,36}(需要协助|协助)|碰撞.{0,24}协助)",
    "v10_capture_block": r"(定金.{0,24}还没有退|车模也没有|感到沮丧|已经在店里召回|想要退货|支付保费|手机支架.*退货)",
    "remote_service": r"(远程为其|远程.{0,12}关|关下后尾门|关一下后尾门)",
    "accident_coord": r"(无人员受伤|报了保险和交警|对接售后协助|协助您车辆定损|车辆事故.{0,80}协助)",
    "soft_product_feedback": r"(向你们信息技术部|向.{0,16}(信息技术部|领导)反馈|请你向.*反馈一下)",
    "lifestyle_positive": r"(乐趣无穷|格外美丽|速度飞起|雾气朦胧|千匹野兽)",
    "free_service_ask": r"(可以免费|免费除|能否免费)",
    "valet_move": r"(代驾到另一个地方|车辆无售后无质量问题|想将车辆从.*代驾)",
    "tow_flat": r"(扎钉漏气|轮胎扎钉漏气|需要拖车)",
    "resolved_self_service": r"(解锁不了.*已成功解锁|随后表示已成功解锁|已成功解锁车辆)",
    "missing_parts": r"(少了.{0,12}配件|缺少.{0,12}配件|缺少背带|接缝处少)",
    "order_account_coord": r"(?s)(小定.*大定|大定.*小定|没有联动|下了小定|两个账号|又.{0,12}手机.{0,24}注册|准备提车.*没有联动|发了.{0,12}邮件.*没有结果)",
    "english_service_relay": (
        r"(vehicle\s+towed|towed\s+to|has\s+not\s+been\s+able\s+to\s+reach|repair\s+is\s+delayed|"
        r"need\s+cc\s+if\s+repair)"),
    "dead_battery_relay": r"(?s)(目前没有电|没有电了.*打不开车门|车辆目前.*没有电|亏电.*打不开)",
    "poetic_drive_share": (
        r"(?s)(路特斯第二天|真的太对味|深踩电门|推背感.*笑起来|英国小女孩|开一整天都|彪悍到不留情面|悬挂软得像|在云上飘|补能焦虑.*可以扔了|这钱花得值|"
        r"#LotusForMe|#电动车真香)"),
    "minor_collision_coord": r"(?s)(发生了摩擦|前保险杠受损|已报交警定责|需要进店维修.*能正常行驶|摩擦.*保险杠.*交警)",
    "soft_sales_system_feedback": r"(?s)(产品非常棒.*购车体验|购车体验有待加强|不是针对我的销售|整个.*销售体系|不应该输在这种地方)",
    "repair_plan_inquiry": r"(?s)(有维修计划吗|上面的车有维修|repair\s+plan|上面的车.*维修计划|此邮件来自组织外部.*维修计划)",
    "tire_flat_overnight": r"(?s)(完全没气|一晚上.*没气|左前轮.*没气|一晚上下来完全没气)",
    "missing_tool_relay": r"(?s)(防盗螺栓.*工具不在|拆卸工具不在|工具不在车上|没有相关工具.*补发|需要补发.*工具|防盗螺栓的拆卸工具)",
    "brand_design_opinion": r"(?s)(高度抄袭.*外观设计|照搬.*原创设计|全方位照搬|品牌格调与独一无二|廉价化，套壳化|游心.*抄袭.*EMEYA)",
    "external_spam": r"(?s)(SEO优化|Google可见性|网站流量|网站审计|谷歌排名改进|当地SEO|你要我送过去吗|注意到几个错误|详细报告以及建议|向您发送详细报告)",
    "repair_eta_relay": r"(?s)(检查维修.*更新CC|更新CC团队|维修ETA|ETA\d+月)",
    "urgent_contact_relay": r"(?s)(加急联系|还没有售后人员主动联系|快到店了.*需要售后|需要售后人员加急|需要售后主动联系)",
    "mall_launch_ask": r"(?s)(怎么还没上|上旬上架吗|中旬上架吗|不是回复的.*上架吗)",
    "unusual_assist_relay": r"(?s)(钻进去一只猫|拆底盘检查|大概.*分钟到店|车辆有一只|高速出口.*(猫|动物)|收费站.*(猫|动物))",
    "app_square_consult": r"(?s)(来源：APP广场|APP广场|没法买车损险|只能买交强险)",
    "staff_callback_relay": r"(?s)(致电用户告知|用户知悉无异议|技术部门答复建议|并告知路径)",
    "post_accident_tow": r"(?s)(事故.*已处理完毕|出了事故.*已处理|想要拖车进店)",
    "lockout_assist": r"(?s)(没带手机.*被锁|没带家钥匙|没有车控功能.*需要售后|家门被锁上了)",
    "nail_tow_relay": r"(?s)(扎钉子了|右后轮扎钉|电话中断.*拒接|回拨.*拒接)",
    "product_option_feedback": r"(?s)(没有FORME的选项|限定拉花没有|缺少帽绳)",
    "ownership_ota_share": r"(?s)(也是老司机了|重新唤醒了内心驾驶|底盘能通过OTA|更适配国内路况|汽车带给我的快乐|刚上市的For Me|Lotus的审美和底盘调教)",
    "v11_incident_praise": r"(?s)(轮胎boom|爆胎|压到大石头).{0,900}(点赞|强推|深表感谢|为.{0,24}门店售后点赞)",
    "v11_maintenance_praise": r"(?s)(第三次保养|保养送去.{0,24}店里).{0,650}(有温度|复购|莲花跑车可以做到|希望.{0,16}保持|老车主)",
    "v11_reward_policy_relay": r"(?s)(告知客户.*阶梯奖励|积分阶梯如何计算|按实际交付台数享受阶梯奖励)",
    "v11_accident_relay": r"(?s)((发生|发生事故)交通事故|发生事故剐蹭|单方事故).{0,140}(协调拖车|已报警|需要协助|拖车下高速|交警需要)",
    "v11_feature_howto": r"(?s)(找不到任何地方的选项|怎样附上图片|不能提交评价|连接是否正常|连接到我的.*应用程序|应用程序连接|车内网络不工作.*询问)",
    "v11_fire_ext_ask": r"(?s)(灭火器.{0,24}需不需要更换|消防灭火器)",
    "v11_points_ask": r"(买车有多少积分|客户在线买车有多少积分)",
    "v11_tire_coord": r"(?s)(和.{0,24}售后门店对接.*更换.{0,12}轮胎|需要更换车辆轮胎)",
    "v11_spoiler_relay": r"后扰流板损坏，需要更换",
    "testdrive_followup": r"(试驾回访|客户评价[三四五]星|评价[三四五]星|评级星级)",
    "appointment_change": r"(取消预约|改约|身体不舒服.{0,20}取消)",
    "soft_charging_share": r"(闪充机器人|接受了一波.{0,24}洗礼|顺路体验了一下|场地卫生|有蟑螂)",
    "neutral_statement": (
        r"(通知|告知|提醒|推送|活动|参与|报名|邀请|有意向|感兴趣|考虑|关注|想关注|客户表示|用户表示|用户称|用户说|客户称|客户反馈|已读|已收到信息|获悉|得知|转发|"
        r"分享|配合|支持|官方发布|公众号|推文|直播|资讯|消息)"),
    "praise": (
        r"(表扬|点赞|不错|给力|感谢|谢谢|多谢|好评|认可|夸赞|赞一个|诚意满满|精致|太好看了|太爱了|礼盒|越来越好|很高兴认识你|提车大吉|满意|挺好|很好|不赖|很棒|"
        r"超棒|靠谱|专业|贴心|高效|及时|推荐|五星|完美|nice|good|热情|耐心|细致|周到|用心|敬业|负责|尽职|细心|温馨|友好|和善|亲切|透彻|到位|清晰|"
        r"讲解清楚|讲得好|讲明白|惊喜|超预期|超出预期|超值|划算|放心|安心|棒极了|棒棒的|赞|很赞|大赞|顶|过硬|出色|体验真的满分|真心推荐|省时省力|让人很放心|"
        r"良好体验|体验很好|体验不错|体验棒|服务很好|服务不错)"),
    "neutral_query": (
        r"(咨询|询问|请教|请问|问一下|问问|想问一下|想问|想了解|了解一下|了解下|了解|打听|看看|了解情况|咨询一下|保养|取送|上门保养|需要保养|解押|什么时候挪|"
        r"超时占位费|想试驾|想试|预约试驾|预约|想要一辆|想买|想入|何时上市|什么时候上市|何时发布|什么时候发布|何时交付|什么时候交付|价格表|配置表|参数表|有没有|是否有|"
        r"是否能|报装|电表|勘测|进度|怎么查|如何查询|查询|核实|确认一下|问一下情况|怎么开启|怎么解决|大家都怎么|再次来电|取消预约|需不需要|是不是|会打开吗|能不能|"
        r"可不可以|咋办|怎么办)"),
    "announcement": r"(正式发布|新品发布|发布会|开启预售|开启预订|开启交付|权益公布|价格公布|官宣|官方公布|上市发布|首发|车展亮相|发布价格|发布预售|新车上市)",
    "sales_testdrive_praise": (
        r"(销售|试驾|顾问|接待|门店|客服).{0,32}(热情|耐心|专业|满意|好评|不错|很好|到位|细致|讲解|态度好|服务很好|服务不错|透彻|贴心|负责|尽职)|(热情|"
        r"耐心|专业|满意|很好|不错|到位|透彻|贴心).{0,32}(销售|试驾|顾问|接待|门店)"),
    "aftersale_praise": r"(售后|保养|维修|进店).{0,28}(很好|不错|满意|专业|耐心|热情|到位|及时|靠谱|高效)|(很好|不错|满意|专业|耐心).{0,28}(售后|保养|维修)",
    "biz_boundary": (
        r"(售后|维修|保养|质保|备件|代步|进店检修|服务门店|回访|理赔|销售|销售顾问|顾问|门店|客服|接待|试驾|意向金|购车|下定|订单|展厅|价格|提车|交付|定金|"
        r"订金|合同|发票)"),
    "unpaid_reward": r"未按阶梯奖励",
    "plain_query_unless": r"不满|投诉|怎么回事|为什么|无人联系|没有人联系|扣除|不一致|核实|用户反馈|客户反馈|故障|坏了|无法|不能|异响|纠纷|太寒酸|拍不出|前后说法|什么情况|要求尽快",
    "maintenance_cost_ask": r"咨询保养费用|提示保养了.{0,32}咨询.{0,12}(?:保养)?费用",
    "bring_the_car": r"安排人把.{0,16}(?:车|车辆)开过来|把车开过来",
    "look_at_it": r"检修|查一下|需不需要",
    "bring_the_car_unless": r"投诉|不满|还没解决|无法启动",
    "relay_unless": r"投诉|不满|非常差|退[款订换]|维权",
    "soft_hope_unless": r"希望(尽快|官方尽快)|必须解决|投诉|不满|退[款订换]|维权|索赔|非常差",
    "inspection_unless": r"非常沮丧|持续存在.{0,16}问题|召回了一个多月",
    "wish_unless": r"退货|退款|投诉|不满意|太差",
    "price_unless": r"乱收费|多收|投诉|不满|退订",
    "assist_unless": r"投诉|不满|非常差|退|换货",
    "unwell": r"身体不舒服",
}
_V11 = ("v11_incident_praise", "v11_maintenance_praise", "v11_accident_relay", "v11_feature_howto", "v11_fire_ext_ask", "v11_points_ask",
        "v11_tire_coord", "v11_spoiler_relay")
_V98 = ("account_admin", "want_arrange", "workslot_inquiry", "followup_contact", "delivery_schedule", "mild_part_note", "advice_ask", "minor_howto",
        "collision_assist")
_V10_LONG = ("poetic_drive_share", "ownership_ota_share")
_V10_MAIL = ("repair_plan_inquiry", "external_spam", "brand_design_opinion")
_V10 = ("remote_service", "accident_coord", "soft_product_feedback", "lifestyle_positive", "free_service_ask", "valet_move", "tow_flat",
        "resolved_self_service", "missing_parts", "order_account_coord", "english_service_relay", "dead_battery_relay", "minor_collision_coord",
        "soft_sales_system_feedback", "tire_flat_overnight", "missing_tool_relay", "repair_eta_relay", "urgent_contact_relay", "mall_launch_ask",
        "unusual_assist_relay", "app_square_consult", "staff_callback_relay", "post_accident_tow", "lockout_assist", "nail_tow_relay", "product_option_feedback",
        *_V10_LONG, *_V10_MAIL)
# Longer texts are allowed to stories and to forwarded mails: whichever kind is in the text sets the limit of all.
_V10_LENGTH = ("any", ("max", 320, ()), ("all", ("any", *_V10_MAIL), ("max", 420, ())), ("all", ("any", *_V10_LONG), ("max", 520, ())))
_V11_LENGTH = ("any", _V10_LENGTH, ("all", ("any", "v11_incident_praise", "v11_maintenance_praise"), ("max", 650, ())))

# Terms with a name, in the order in which they may refer to one another.
TERMS = {
    "reward_policy": ("all", "v11_reward_policy_relay", ("not", "unpaid_reward")),
    "v11_any": ("any", "reward_policy", *_V11),
    "soft_hope": ("all", "soft_hope_suggest", ("not", "soft_hope_unless")),
    "hard_negative_found": ("all", "hard_negative", ("not", ("any", "resolved_issue_praise", "hard_negative_praise_override", "facility_service_request",
                                                            ("all", "service_inspection_request", ("not", "inspection_unless")), "mixed_satisfaction",
                                                            "testdrive_high_rating", "survey_high_rating", "soft_hope", "relay_benign", "v11_accident_relay"))),
    "business_issue": ("any", "mall_product_complaint",
                       ("all", ("not", "community_chatter"), ("not", "v11_any"), ("any", "business_issue_guard", "delivery_complaint", "symptom_inquiry"))),
    "plain_query": ("all", "neutral_query", ("not", "plain_query_unless")),
    "false_capture": ("any", "v12_followup_negative", "v12_mixed_praise_issue", "v12_issue_with_praise", "v12_statement_issue", "v12_neutral_query_pullback",
                      ("all", "v12_query_as_issue", ("not", "plain_query"))),
    "consult_relay": ("any", "maintenance_cost_ask", ("all", "bring_the_car", "look_at_it", ("not", "bring_the_car_unless"))),
    "spared": ("any", "consult_relay", "v11_any",
               ("all", ("not", "false_capture"), ("any", "praise", "resolved_issue_praise", "testdrive_high_rating", "survey_high_rating", "relay_benign"))),
    "pullback": ("all", ("not", "spared"), ("any", "false_capture", "v12_service_pullback", "v12_product_pullback", "v12_experience_pullback")),
    "negated": ("all", "negation_before_positive", ("not", ("any", "exaggerated_praise", ("all", "unwell", "appointment_change"), "testdrive_high_rating"))),
    "no_hard_negative": ("not", "hard_negative_found"),
    "charging_share": ("all", "soft_charging_share", ("not", "lfc_charging_complaint"), "no_hard_negative"),
    "charging_blocked": ("all", "lfc_charging_domain", ("any", "lfc_charging_complaint", ("not", (
        "any", "charging_share", ("all", "soft_suggestion", "no_hard_negative"), "lfc_charging_consult", "neutral_query", "lfc_question_tone")))),
    "wider": ("all", ("not", "v98_capture_block"), ("not", "business_issue"), "no_hard_negative"),
}
# (code, term) in order; the first that holds stands.
BLOCKED = [
    ("business_issue_guard", "business_issue"), ("v12_regression_pullback", "pullback"), ("hard_negative", "hard_negative_found"), ("negation", "negated"),
    ("lfc_charging_complaint", ("all", "charging_blocked", "lfc_charging_complaint")), ("lfc_charging_domain", "charging_blocked"),
    ("srv_quality_issue", "srv_quality_issue"),
]
ELIGIBLE = [
    ("short_intent", ("max", 15, ("squeezed", "short_intent"))), ("short_benign", ("max", 15, ("squeezed", "short_benign"))),
    ("weak_benign", ("max", 35, "weak_benign")), ("interest_intent", "interest_intent"), ("feedback_service_need", ("max", 120, "feedback_service_need")),
    ("damage_inquiry", ("all", "damage_inquiry", ("any", ("max", 120, ("any", "facility_service_request", ("not", "hard_negative_found"))),
                                                  ("max", 200, "service_inspection_request")))),
    ("soft_suggestion", ("all", "soft_suggestion", "no_hard_negative")), ("ota_hype", ("all", "ota_hype_praise", "no_hard_negative")),
    ("wish_feedback", ("all", "wish_feedback", ("not", "wish_unless"), "no_hard_negative")),
    ("price_inquiry", ("all", "price_inquiry", ("not", "price_unless"), "no_hard_negative")),
    ("assist_coordination", ("max", 120, ("all", "assist_coordination", ("not", "assist_unless")))),
    ("soft_experience_share", ("max", 90, ("all", "soft_experience_share", "no_hard_negative"))),
    ("relay_benign", ("all", "relay_benign", ("not", "relay_unless"), "no_hard_negative")), ("soft_hope_suggest", "soft_hope"),
    ("v98_no_capture", ("max", 220, ("all", "wider", ("any", *_V98)))),
    ("v10_no_capture", ("all", "wider", ("not", "v10_capture_block"), ("any", *_V10), _V10_LENGTH)),
    ("v11_m3", ("all", "v11_any", ("not", "v10_capture_block"), ("any", "v11_accident_relay", ("not", "v98_capture_block")), ("not", "business_issue"),
                "no_hard_negative", _V11_LENGTH)),
    ("testdrive_followup", ("all", "testdrive_followup", "no_hard_negative")), ("appointment_change", ("all", "appointment_change", "no_hard_negative")),
    ("soft_charging_share", "charging_share"), ("neutral_statement", ("max", 55, "neutral_statement")), ("praise", "praise"), ("neutral_query", "neutral_query"),
    ("announcement", "announcement"), ("sales_testdrive_praise", "sales_testdrive_praise"), ("aftersale_praise", "aftersale_praise"),
    ("biz_boundary_praise", ("all", "biz_boundary", "praise")), ("lfc_consult", ("all", "lfc_charging_domain", ("any", "lfc_charging_consult", "neutral_query"))),
]
# A code that is named but does not make a text eligible where this holds.
NAMED_ONLY = {"testdrive_followup": "v12_followup_negative"}

CAPTURE = dict(signals=SIGNALS, terms=TERMS, blocked=BLOCKED, eligible=ELIGIBLE, named_only=NAMED_ONLY)
