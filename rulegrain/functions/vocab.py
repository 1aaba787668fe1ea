"""Default Chinese vocabularies.

Fixed values: word lists, lookup tables, thresholds and patterns that decide results. All of
them are defaults only; every operator takes its vocabulary as an argument.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values: rule types, conflicts
RULE_TYPE_POLARITY = {
    "PRO_FORBIDDEN": "forbid",
    "PER_AUTH": "allow",
    "OBL_MANDATORY": "require",
    "OBL_ONGOING": "require",
    "PRC_FLOW": "require",
    "RPT_DISCLOSURE": "require",
}
ACTIONABLE_RULE_TYPES = [
    "PRO_FORBIDDEN", "PER_AUTH", "OBL_MANDATORY", "OBL_ONGOING", "PRC_FLOW", "RPT_DISCLOSURE", "VAL_THRESHOLD",
]
FORBID_KEYWORDS = ["不得", "禁止", "不予", "中止", "暂停", "只收不付"]
ALLOW_KEYWORDS = ["可以", "允许", "可恢复", "可办理", "可申请", "恢复"]
GENERIC_OBJECTS = ["票据", "账户", "业务", "信息", "事项", "材料", "内容", "规定"]
NUMERIC_UNITS = "个|户|次|笔|日|天|月|年|小时|分钟|万元|元|%|倍"
CHINESE_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000}
CHINESE_MYRIAD = "万"
SCOPE_PUNCTUATION = "，。；：、,.!！?？“”\"'‘’（）()【】[]<>《》/\\-"

# ---------------------------------------------------------------- fixed values: text preparation
ARTICLE_MARK = r"第[一二三四五六七八九十百零〇0-9]+条"
SECTION_MARK = r"第[一二三四五六七八九十百零〇0-9]+[章节]"
ITEM_MARK = r"[一二三四五六七八九十]+、"
SUBITEM_MARK = r"（[一二三四五六七八九十]+）"
APPENDIX_MARK = r"附[一二三四五六七八九十0-9]+"
CHUNK_ARTICLE_START = r"^\s*(第[零一二三四五六七八九十百]+条|[一二三四五六七八九十]+、)"
APPENDIX_TITLE = "正确填写票据和结算凭证的基本规定"
FIRST_APPENDIX = "附一"
SECOND_APPENDIX = "附二"
NORM_PUNCTUATION = "，,。；;：:“”\"'‘’（）()【】[]—-"
DOC_NAME_PUNCTUATION = "《》【】（）()[]<>“”\"'‘’、，,。；;：:·-—_"
OCR_FIXES = [("入民币", "人民币"), ("出禀日期", "出票日期")]
UNSPECIFIED = "未指定"
DOCUMENT_CODES = [("票据法", "NIL"), ("支付结算", "PSM"), ("反洗钱", "AML"), ("账户管理", "BAM"), ("商业银行", "CBL")]
RULE_ENTITY_TERMS = [
    "转账支票", "支票", "票据", "出票日期", "核心日期", "提示付款", "小写金额", "大写金额", "金额", "签章",
    "财务专用章", "个人章", "出票人", "持票人", "付款人", "中国人民银行", "人民币符号",
]

# ---------------------------------------------------------------- fixed values: entity normalisation
ACTOR_CATEGORIES = ["机构简称", "主体别称"]
OBJECT_CATEGORIES = ["账户简称", "法规简称"]
REFERENCE_GROUPS = {
    "WHO": ["法律主体 (WHO)", "法律主体(WHO)", "法律主体", "LEGAL_ACTORS"],
    "WHAT": ["核心事项 (WHAT)", "核心事项(WHAT)", "核心事项", "WHAT_CONCEPTS"],
    "WHEN": ["时间情境 (WHEN)", "时间情境(WHEN)", "时间情境", "WHEN_CONTEXTS"],
    "WHERE": ["空间情境 (WHERE)", "空间情境(WHERE)", "空间情境", "WHERE_CONTEXTS"],
}
DICTIONARY_CATEGORIES = {
    "LEGAL_ACTORS": "法律主体(WHO)", "法律主体": "法律主体(WHO)",
    "WHAT_CONCEPTS": "核心事项(WHAT)", "核心事项": "核心事项(WHAT)",
    "WHEN_CONTEXTS": "时间情境(WHEN)", "时间情境": "时间情境(WHEN)",
    "WHERE_CONTEXTS": "空间情境(WHERE)", "空间情境": "空间情境(WHERE)",
    "RULE_TYPES": "规则类型(RULES)", "规则类型": "规则类型(RULES)",
    "BUSINESS_CATEGORIES": "业务分类", "业务分类": "业务分类",
}
OBJECT_SOURCE_CATEGORY = "核心事项 (WHAT)"
TIME_SOURCE_CATEGORY = "时间情境 (WHEN)"
TWO_CHARACTER_OBJECTS = ["支票", "本票", "汇票", "票据", "现金"]
OBJECT_SUFFIXES = [
    "账户", "汇票", "本票", "支票", "票据", "银行卡", "信用卡", "存折", "存单", "凭证", "通知", "身份证", "证件",
    "证明", "合同", "协议", "资料", "信息", "记录", "清单", "文件", "执照", "许可证", "名称",
]
OBJECT_CORE_WORDS = ["账户", "票据", "汇票", "本票", "支票"]
OBJECT_REJECT_ENDINGS = ["人", "单位", "机关"]
OBJECT_REJECT_WORDS = ["开立的", "名下", "外的其他", "被冒用", "行为", "情况", "阶段"]
OBJECT_BLOCKLIST = [
    "文字", "标识", "地点", "相近", "销户", "签名", "后手", "承兑", "损失", "通知", "全体", "保证", "本法",
    "一般", "专用", "市", "机关", "军队", "资料", "证明", "规章", "法规", "工资", "奖金", "稿费", "继承", "赠",
    "证券", "期货", "信托", "账务", "幅度", "佣金", "经办", "查复", "涂改", "倒卖", "协调", "管理", "监督",
    "面签", "媒体", "折页", "微博", "收集", "情况", "其", "资金", "照片", "转账", "占比", "时性", "金额",
    "号码", "退款", "签发", "资信", "打孔", "剪角", "毁坏", "户名", "信", "航运", "全部", "规格", "数量",
    "价格", "货物", "丢失", "错投", "错拍", "漏拍", "重拍", "止付", "变更", "伪造",
]
TIME_BLOCKLIST = [
    "变更", "持续性", "开户", "签发", "票据签发", "法定代表人", "承付人", "承兑", "棉", "洗钱", "组织", "流通",
    "票据", "一般", "常态化", "逃匿", "设计", "考勤", "终止", "受托人", "托管人", "收款", "网络", "账户",
    "机构", "有效性", "后续", "同步", "全程", "导出", "任何时候", "事前", "事中", "事后",
]
TIME_REJECT_STARTS = ["且", "并", "及", "和", "或"]
TIME_REJECT_WORDS = ["认定", "纳入名单", "联系电话", "法定代表人", "负责人"]
TIME_FIXED_TERMS = ["当日", "次日", "当月", "次月", "当年", "次年", "每日", "每月", "每年", "实时", "及时", "定期", "立即", "长期"]
T_PLUS_PATTERN = r"[Tt]\s*[-+]\s*\d+\s*(?:个)?(?:工作日|营业日|自然日|交易日|日|天|周|月|年)?(?:内|以内|之内|前|后)?"
DURATION_PATTERN = r"\d+[个]?(?:工作日|营业日|自然日|交易日|日|天|周|星期|个月|月|季度|年)(?:内|以内|之内|前|后)"
TIME_CONFIDENT_PATTERNS = [
    T_PLUS_PATTERN,
    r"\d{4}年\d{1,2}月\d{1,2}日(?:起|前|后|内|以内|之内)?",
    DURATION_PATTERN,
    r"(?:每|各)(?:日|周|星期|月|季度|年)(?:末|初)?",
    r"(?:当日|次日|当月|次月|当年|次年|每日|每月|每年|实时|及时|定期|立即|长期)",
    r".*(?:时|前|后|期间|期内|以内|之内|之后|之前)$",
]
TIME_SCENE_ENDINGS = r".*(?:时|前|后|期间|以内|之内|之后|之前|届满前|届满后|期内)"
TIME_SEARCH_PATTERNS = [
    T_PLUS_PATTERN,
    DURATION_PATTERN,
    r"(?:每|各)?(?:日|周|星期|月|季度|年)(?:末|初)?",
    r"(?:到期日?|截止日?|生效日?|失效日?|起始日?|终止日?)",
    r"(?:提示付款期限|提示付款期|付款期限|办理期限|报告期限|保存期限)(?:内|前|后|以内|之内)?",
]
TIME_SUFFIXES = ["之前", "之后", "期间", "期内", "以内", "之内", "日前", "日后", "前", "后", "时"]
TIME_ACTIONS = [
    "申请开立", "开立", "办理", "受理", "签发", "提示付款", "提出付款请求", "付款", "承付", "审核", "核验", "核实",
    "重新识别", "识别", "签章", "贴现", "取得", "收到", "行使追索权", "提出",
]
TIME_FAMILIES = [
    ("银行结算账户", "账户"), ("支付账户", "账户"), ("存款账户", "账户"), ("账户", "账户"), ("银行卡", "银行卡"),
    ("信用卡", "信用卡"), ("银行汇票", "汇票"), ("商业汇票", "汇票"), ("汇票", "汇票"), ("银行本票", "本票"),
    ("本票", "本票"), ("支票", "支票"), ("票据", "票据"), ("身份证明文件", "身份证明"), ("身份证件", "身份证明"),
    ("身份证", "身份证明"), ("身份资料", "身份资料"), ("客户身份", "身份资料"), ("通知", "通知"),
    ("证明文件", "材料"), ("文件", "材料"), ("资料", "材料"), ("凭证", "凭证"), ("现金", "现金"), ("交易", "交易"),
]
WHEN_ENDINGS = ["时", "前", "后", "期间", "期内", "以内", "之内", "之前", "之后"]
WHEN_WORDS = ["日起", "期限", "当日", "次日"]
WHEN_SHORT_TERMS = ["当日", "次日", "每日", "每月", "每年"]

# ---------------------------------------------------------------- fixed values: taxonomy
UNCLASSIFIED_CODE = "UNCAT-00-00"
UNCLASSIFIED_PATH = "待分类 > 待分类 > 待分类"
UNCLASSIFIED_NAME = "待分类"
UNCLASSIFIED_REMARK = "无法归入现有分类的原子知识统一打此标签。"
PRIMARY_SECTION = "业务管理类"
SECOND_SECTION = "基础管理类"
GENERIC_TERMS = [
    "业务", "管理", "办理", "处理", "核查", "核对", "报告", "报送", "流程", "资料",
    "档案", "信息", "系统", "台账", "运营", "监控", "检查", "管理类", "业务管理类", "基础管理类",
]
CLASSIFIER_WEIGHTS = {
    "module": 24, "category": 6, "project": 32,
    "scenario_module": 14, "scenario_category": 4, "scenario_project": 18,
    "legacy_module": 8, "legacy_category": 3, "long_term": 5, "short_term": 3,
}

# ---------------------------------------------------------------- fixed values: question answering
DETERMINISTIC_RULE_TYPES = ["OBL_MANDATORY", "OBL_ONGOING", "PRO_FORBIDDEN", "PER_AUTH", "VAL_THRESHOLD", "PRC_FLOW"]
TYPE_A_RULE_TYPES = ["OBL_MANDATORY", "OBL_ONGOING", "PRO_FORBIDDEN", "PER_AUTH", "PRC_FLOW"]
TYPE_B_RULE_TYPES = ["OBL_MANDATORY", "OBL_ONGOING", "PER_AUTH", "PRC_FLOW"]
TYPE_C_RULE_TYPES = ["DEF_SCOPE"]
MAX_FORMAL_ATOMS = 12
QUESTION_TYPE_TERMS = {
    "B": ["谁可以", "谁能", "哪些机构", "哪些单位", "什么主体", "哪方", "哪些人", "谁有权", "谁负责", "谁来"],
    "C": ["什么情况", "何时", "在什么条件", "什么时候", "触发条件", "适用条件", "是什么意思", "是指", "定义", "如何界定"],
    "A": ["必须", "应当", "应该", "需要", "有何要求", "怎么做", "如何处理", "不得", "禁止", "可以", "有权"],
}
COMPLEX_INTENT_TERMS = ["是否", "能否", "可否", "如何", "怎么", "哪些条件", "满足哪些", "什么材料", "哪些材料", "签章", "背书", "支取现金"]
LIST_SEPARATORS = ["、", "；", ";"]
FORBIDDEN_QUESTION_TERMS = ["不得", "禁止", "不能", "不可", "不可以", "不予"]
MATERIAL_QUESTION_TERMS = ["材料", "资料", "证明", "证件", "凭证", "文件", "提交", "提供", "出具"]
MATERIAL_ACTION_TERMS = ["出具", "提交", "提供", "报送", "留存"]
MATERIAL_OBJECT_TERMS = ["材料", "资料", "证明", "证件", "凭证", "文件", "营业执照", "批文", "申请书", "登记证", "许可证", "身份证"]
PERMISSION_QUESTION_TERMS = ["能否", "是否可以", "可以吗", "可否", "可不可以", "可以"]
CASH_QUESTION_TERMS = ["现金", "支取现金"]
CHANGE_QUESTION_TERMS = ["变更", "更名", "名称"]
WEAK_EVIDENCE_TERMS = ["无具体条款", "隐含", "外部引用不明", "未指明"]
DEFINITION_QUESTION_TERMS = ["是什么意思", "是指", "定义", "如何界定"]
TYPE_B_ACTION_TERMS = [
    "核发", "签发", "核准", "审批", "批准", "审定", "审核", "审查", "留存", "出具", "开立", "办理", "报告", "制定",
    "规定", "管理", "监管", "负责",
]
PRECISE_OBJECT_TERMS = [
    "开户登记证", "基本存款账户开户登记证", "票据凭证的格式和印制管理办法", "本票出票人资格", "农民工工资专用账户",
    "临时存款账户", "空头支票", "只收不付", "客户身份识别义务", "客户身份资料", "交易记录", "银行汇票丧失",
]
CONDITION_SCOPES = [
    ("offsite_account_scope", ["异地", "经营地", "注册地", "不在同一行政区域", "不在同一"],
     ["异地", "经营地", "注册地", "不在同一行政区域", "不在同一"]),
    ("overdue_payment_scope", ["超过提示付款期限", "逾期", "不获付款", "未获付款", "提示付款期限内"],
     ["超过", "逾期", "不获付款", "未获付款", "期限后", "提示付款期限"]),
    ("cash_mark_scope", ["填明", "注明", "现金字样"], ["填明", "注明", "现金字样"]),
    ("lost_instrument_scope", ["票据丧失", "丧失", "遗失", "挂失"], ["票据丧失", "丧失", "遗失", "挂失"]),
    ("qualified_condition_scope", ["符合条件", "符合下列条件", "满足条件"], ["符合条件", "符合", "满足条件", "哪些条件"]),
    ("unbanked_holder_scope", ["未在银行开立存款账户", "未在银行开立账户"], ["未在银行开立存款账户", "未在银行开立账户"]),
]
GENERIC_HOW_VALUES = ["应出具", "还应出具", "申请开立", "可以申请开立", "应当开立", "应当按规定开立并启用"]

# ---------------------------------------------------------------- fixed values: evidence recall
GENERIC_FOCUS_TERMS = [
    "业务", "管理", "办理", "处理", "流程", "规则", "材料", "资料", "系统", "信息",
    "账户", "票据", "银行", "客户", "单位", "个人", "机构", "要求", "规定", "审核",
    "核查", "核对", "判断", "结论", "场景", "模块", "条款", "知识", "合规", "查验",
]
DIRECTION_NAMES = {
    "A": "业务向下召回", "B": "同层横向召回", "C": "法规结构邻接召回",
    "D": "规则语义补全召回", "E": "例外禁止优先召回", "F": "上下位规范补充召回",
}
SEMANTIC_BUCKETS = {
    "definition": (["定义", "范围", "适用对象", "主体范围", "是指", "包括", "分为"],
                   ["是指", "包括", "分为", "适用于", "所称"], ["DEF_SCOPE"]),
    "threshold": (["阈值", "金额", "期限", "时间", "天数", "时限", "边界"],
                  ["日内", "年内", "个月", "以上", "以下", "超过", "不超过", "期限", "之日起"], ["VAL_THRESHOLD"]),
    "material": (["材料", "证明", "证件", "凭证", "印鉴", "签章", "原件", "复印件"],
                 ["材料", "证明", "证件", "凭证", "印鉴", "签章", "原件", "复印件"], ["PRC_FLOW", "OBL_MANDATORY"]),
    "process": (["流程", "审核动作", "核查动作", "步骤", "方式", "如何审核", "比对字段"],
                ["应当", "必须", "须", "审查", "核查", "核对", "留存", "办理", "方可"],
                ["PRC_FLOW", "OBL_MANDATORY", "OBL_ONGOING"]),
    "exception": (["例外", "禁止", "除外", "但书", "特殊情形", "限制"],
                  ["不得", "不予", "除外", "但是", "但", "特殊情况", "一律", "禁止"], ["PRO_FORBIDDEN", "PER_AUTH"]),
}
EXCEPTION_FOCUS_TERMS = ["不得", "不予", "除外", "但是", "特殊情况"]
MATERIAL_TERMS = ["材料", "证明", "证件", "凭证", "身份证", "印鉴", "解讫通知", "签章", "原件", "复印件", "背书"]
PROCESS_TERMS = ["办理", "审核", "核查", "核对", "签章", "背书", "提示付款", "提交", "留存", "执行", "动作"]
THRESHOLD_TERMS = ["金额", "现金", "时限", "期限", "日内", "月内", "年内", "超过", "不超过", "阈值", "字样"]
DEFINITION_TERMS = ["定义", "是指", "包括", "范围", "适用对象", "所称"]
PROHIBITION_TERMS = ["不得", "不予", "禁止", "不能", "不可"]
EXCEPTION_TERMS = ["除外", "例外", "但是", "但", "特殊情形", "可以"]
HOW_QUESTION_TERMS = ["如何", "怎么"]
EVIDENCE_BUCKETS = [
    ("required_actions", ["PRC_FLOW", "OBL_MANDATORY", "OBL_ONGOING", "EVT_TRIGGER"],
     ["应当", "必须", "须", "办理", "审核", "核查", "核对", "提交", "提供", "留存", "签章", "背书"], 5),
    ("required_materials", [],
     ["材料", "证明", "证件", "凭证", "身份证", "印鉴", "签章", "原件", "复印件", "解讫通知", "背书"], 5),
    ("prohibitions", ["PRO_FORBIDDEN"], ["不得", "不予", "禁止", "不能", "不可"], 5),
    ("exceptions", ["PER_AUTH"], ["除外", "但", "但是", "特殊情况", "例外", "可以"], 5),
    ("time_limits", ["VAL_THRESHOLD"],
     ["期限", "日内", "天内", "月内", "年内", "以上", "以下", "超过", "不超过", "届满"], 5),
    ("definitions", ["DEF_SCOPE"], ["是指", "包括", "分为", "所称", "定义"], 4),
]
GAP_TYPE_RULES = [
    ("例外/禁止缺口", ["不得", "不予", "禁止", "除外", "例外", "但书", "特殊情形", "限制性"]),
    ("主体范围缺口", ["主体", "持票人", "出票人", "收款人", "付款人", "适用对象", "主体范围"]),
    ("定义范围缺口", ["定义", "是指", "包括", "范围", "所称", "定义边界"]),
    ("判断条件缺口", ["前提条件", "触发条件", "办理条件", "判断条件", "实质性触发条件", "是否必须", "是否限于", "是否需验证", "是否可以"]),
    ("材料缺口", ["材料", "证明", "证件", "凭证", "身份证", "印鉴", "解讫通知", "附件", "原件", "复印件"]),
    ("流程动作缺口", ["流程", "步骤", "审核", "核查", "核对", "签章", "背书", "办理动作", "执行动作"]),
    ("时限阈值缺口", ["期限", "时限", "日内", "月内", "年内", "超过", "不超过", "阈值", "金额", "现金字样"]),
    ("规范依据缺口", ["出票行", "代理行", "上位法", "实施细则", "规范依据", "条款依据", "法条依据"]),
    ("事实核验缺口", ["备付", "头寸", "核验", "验证", "状态", "真实性", "一致性"]),
]
OTHER_GAP = "其他缺口"
GAP_SEVERITY = {
    "例外/禁止缺口": "阻断型", "主体范围缺口": "阻断型", "定义范围缺口": "阻断型", "判断条件缺口": "关键型",
    "材料缺口": "关键型", "流程动作缺口": "关键型", "时限阈值缺口": "关键型", "规范依据缺口": "关键型",
    "事实核验缺口": "复核型", "其他缺口": "复核型",
}
GAP_SCOPE = {
    "例外/禁止缺口": "全局阻断", "主体范围缺口": "全局阻断", "定义范围缺口": "全局阻断", "判断条件缺口": "子结论阻断",
    "材料缺口": "子结论阻断", "流程动作缺口": "子结论阻断", "时限阈值缺口": "子结论阻断", "规范依据缺口": "子结论阻断",
    "事实核验缺口": "人工复核项", "其他缺口": "人工复核项",
}
GAP_CONDITIONS = {
    "例外/禁止缺口": "当结论涉及禁止、限制、例外或授权条款，但证据未覆盖完整的限制与例外边界时，不能直接输出确定性结论。",
    "主体范围缺口": "当问题依赖特定办理主体、权利主体或适用对象，而证据未明确主体范围时，会阻断最终结论。",
    "定义范围缺口": "当核心术语或适用范围未被定义清楚时，结论容易出现适用对象错误或边界错误。",
    "判断条件缺口": "当问题直接询问“能否办理/能否支取/能否放行”但证据未覆盖触发条件或适用前提时，不能直接输出确定性子结论；若检索已穷尽，可转人工复核或输出有条件判断。",
    "材料缺口": "当办理结论依赖明确提交材料，而证据未列全材料项时，不能直接输出“可办理”。",
    "流程动作缺口": "当办理结论依赖审核、签章、核验、留存等动作，而证据未覆盖必要动作时，结论只能停留在阶段性判断。",
    "时限阈值缺口": "当结论依赖提示付款期限、金额阈值、现金字样等限制条件，而证据未覆盖这些条件时，不能输出稳定结论。",
    "规范依据缺口": "当关键限制条件需要结合相邻条款、实施细则或其他规范理解，而当前依据不足时，结论需要补证或人工复核。",
    "事实核验缺口": "当问题不仅需要法条，还需要对资金、状态、票面或真实性做事实核验时，规则证据本身不足以独立完成结论。",
    "其他缺口": "当前缺口不属于既定模式，需要结合上下文人工判断其是否阻断最终结论。",
}
FINAL_CONCLUSIONS = ["可办理", "不可办理", "有条件可办理", "需补材料后办理", "需人工复核", "证据不足待补召回"]

# ---------------------------------------------------------------- fixed values: instrument checks
CAPITAL_DIGITS = {
    "零": 0, "〇": 0, "壹": 1, "贰": 2, "貳": 2, "叁": 3, "肆": 4, "伍": 5, "陆": 6, "陸": 6, "柒": 7, "捌": 8, "玖": 9,
}
CAPITAL_UNITS = {"拾": 10, "佰": 100, "仟": 1000}
CAPITAL_SECTIONS = {"万": 10000, "萬": 10000, "亿": 100000000, "億": 100000000}
FINANCE_SEALS = ["财务专用章", "公章"]
PERSONAL_SEALS = ["个人章", "法人章", "法定代表人章", "签名", "签字", "代理人签章"]
CHECK_TYPES = [
    (1, "ISSUE_DATE_WITHIN_10_DAYS"), (2, "ISSUE_DATE_IN_CHINESE_UPPERCASE"), (3, "LOWER_AMOUNT_HAS_RMB_SYMBOL"),
    (4, "UPPER_AMOUNT_EQUALS_LOWER_AMOUNT"), (5, "AMOUNT_IS_REQUIRED"), (6, "UPPER_AMOUNT_FORMAT_IS_VALID"),
    (7, "SIGNATURE_SET_IS_COMPLETE"),
]
UPPER_AMOUNT_CHARACTERS = r"^[人民币零〇壹贰貳叁肆伍陆陸柒捌玖拾佰仟万萬亿億圆元角分整正\s]+$"

# ---------------------------------------------------------------- fixed values: review and quality
REVIEW_PENDING, REVIEW_PASS, REVIEW_QUESTIONABLE, REVIEW_WRONG = "待判断", "通过", "存疑", "明显错误"
TRUE_WORDS = ["1", "true", "yes", "y", "是"]
QUALITY_LOW, QUALITY_HIGH = 0.60, 0.92
