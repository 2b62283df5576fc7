"""Fixed values of the claim rules: word lists by nature and strength, field signals, risk terms."""

# Words that mark speculation, opinion and fact, strong and weak, in Chinese and English.
NATURE_WORDS = {
    "speculation": {
        "strong": ("可能", "或将", "有望", "预计", "预测", "估计", "或许", "也许", "大概率", "很有可能", "极有可能", "很可能", "似乎", "好像", "疑似", "据传", "传闻", "据说", "据报道", "据称", "据透露", "据悉", "有消息称", "有传言称", "尚不确定", "尚无定论", "难以确定", "难以预测", "不排除", "仍存变数", "或", "有可能", "概率"),
        "weak": ("将", "将会", "未来", "计划", "探索", "尝试", "拟", "即将", "下一步", "下一阶段", "远期", "趋势", "方向", "打算", "正在考虑", "预期", "展望", "布局", "规划", "准备", "酝酿", "研发中", "开发中", "筹建", "筹办", "推进中", "筹备", "下阶段", "目标", "愿景", "瞄准", "进军", "发力", "将推出", "将发布", "将上线", "将启动", "希望", "期望", "致力于", "力求", "争取", "谋求", "新兴", "崛起", "崭露头角", "初露锋芒", "渐成趋势"),
        "strong_en": ("could", "might", "may", "likely to", "expected to", "predicted to", "projected to", "potentially", "possibly"),
        "weak_en": ("will", "would", "plans to", "aims to", "seeks to", "exploring", "considering", "in the future", "upcoming", "rumored to", "reportedly", "allegedly"),
    },
    "opinion": {
        "strong": ("最好", "最强", "顶级", "一流", "最佳", "最受欢迎", "最大", "卓越", "绝对领先", "无可匹敌", "无与伦比", "最权威", "最具", "最专业", "最先进", "最值得", "无可争议", "遥遥领先", "首屈一指", "独一无二", "举世闻名", "享誉全球", "当之无愧", "独占鳌头", "无出其右", "傲视", "冠绝", "称雄", "唯一", "第一", "100%", "绝对", "完全", "彻底"),
        "weak": ("领先", "受欢迎", "优质", "出色", "优秀", "强大", "深受好评", "备受赞誉", "公认", "知名", "行业领先", "体验好", "服务优质", "用户认可", "极具", "颇受", "广受", "备受", "备受瞩目", "引人注目", "脱颖而出", "名列前茅", "口碑", "好评如潮", "推荐", "赞誉", "盛赞", "推崇", "专业", "权威", "精英", "高端", "创新", "突破", "先进", "前沿", "标杆", "典范", "领军", "龙头", "标杆企业", "代表性", "标志性", "典型", "认可", "信赖", "青睐", "追捧", "热捧", "首选", "首选品牌", "必选", "值得信赖", "值得推荐"),
        "strong_en": ("best", "top", "excellent", "superior", "outstanding", "premier", "unmatched", "unrivaled", "ultimate"),
        "weak_en": ("leading", "popular", "premium", "highly rated", "renowned", "widely regarded", "better than", "more.*than"),
    },
    "fact": {
        "strong": ("成立于", "创立于", "总部设在", "总部位于", "注册于", "注册地址", "注册地", "发源于", "全称", "原名", "前身", "隶属于", "注册资本", "法人代表", "法定代表人", "统一社会信用代码", "位于", "地址", "坐落于"),
        "weak": ("拥有", "覆盖", "员工", "营收", "收入", "融资", "上市", "门店", "店铺", "家门店", "直营", "加盟", "超过", "达到", "实现", "累计", "已获得", "获得", "提供", "包含", "推出", "业务", "产品", "服务", "旗下", "包括", "主要有", "合作", "签约", "入驻", "开设", "进驻", "布局", "设有", "设立", "建立", "建成", "年营收", "年收入", "市值", "估值", "同比增长", "环比增长", "市场份额", "占有率"),
        "strong_en": ("founded in", "headquartered in"),
        "weak_en": ("has", "owns", "operates", "revenue", "launched in", "acquired", "reported", "currently", "as of", "since", "employees", "stores", "locations"),
    },
}

# Negations that void a word within five characters.
NEGATIONS = ("不是", "并非", "没有", "不认为", "无法", "不能", "并非如此", "并不", "并未", "决不", "绝非", "否认", "澄清", "驳斥", "辟谣", "不", "未", "无", "尚未", "难以", "不一定", "并不意味着", "不代表", "未必")
# The same in English.
NEGATIONS_EN = ("not", "isn't", "aren't", "doesn't", "don't", "never", "no longer", "cannot", "can't")

# Patterns of numbers and of counting phrases.
NUMERIC = r"(?i)[0-9]{4}\s*年|[0-9]{1,2}\s*月|[0-9]{1,2}\s*日|第\s*[0-9]+|[0-9]+[家个项次名位只台座间处所]|[0-9]+[%％]|百分之\s*[0-9]+|[0-9]+\s*[万亿]|[0-9]+\s*[元块]|[0-9]+[倍成]|\$[0-9]+[BKMT]?|[0-9]+\s*(stores|employees|locations|users|customers|revenue|million|billion|trillion)"
STRUCTURAL = r"截至\s*[0-9]{4}|累计\s*[0-9]+|已有\s*[0-9]+|超过\s*[0-9]+|达到\s*[0-9]+|共\s*[0-9]+|[0-9]+\s*[～~至到-]\s*[0-9]+"
# Particles that make a question or a guess of a statement.
PARTICLES = ("吧", "吗", "呢")

# Words that show which field of the fact record a sentence is about, in the order in which they are tried.
FIELD_SIGNALS = {
    "industry": ("行业", "领域", "属于", "产业", "垂直", "是一家"),
    "category": ("品类", "类别", "类型", "细分", "分类"),
    "positioning": ("定位", "核心", "主打", "专注于", "致力于"),
    "target_users": ("用户", "客户", "消费者", "面向", "人群", "服务"),
    "core_products": ("产品", "提供", "推出", "上线", "包含"),
    "core_features": ("功能", "特性", "特点", "能力", "支持"),
    "key_differentiators": ("优势", "不同", "区别", "特色", "独特", "差异化"),
    "target_competitors": ("竞品", "竞争", "对手", "替代", "同行"),
    "official_name": ("公司", "企业", "品牌", "集团", "平台", "名称", "官方", "全称", "名为", "称为", "叫做"),
    "core_scenarios": ("场景", "用途", "应用", "解决", "需求"),
    "forbidden_claims": ("领先", "第一", "最大", "最好", "唯一", "最强", "最"),
}
# What a claim about a field is about.
PREDICATES = {"official_name": "identity", "industry": "industry", "category": "industry", "positioning": "positioning", "target_users": "target_user", "core_products": "product", "core_features": "product", "key_differentiators": "positioning", "target_competitors": "competitor", "core_scenarios": "scenario", "forbidden_claims": "reputation"}
# Kinds of error by field.
ERROR_TYPES = {"official_name": "identity_error", "category": "category_error", "industry": "category_error", "positioning": "positioning_error", "core_products": "feature_error", "core_features": "feature_error", "target_competitors": "competitor_confusion"}
# Words of answers about a category.
INDUSTRY_WORDS = ("行业", "品类", "工具", "平台", "推荐", "选择")
# Words that claim too much.
OVERCLAIMS = ("领先", "第一", "最大", "最好", "唯一", "最强", "顶级", "绝对")
# Words of absolute claims.
ABSOLUTES = ("唯一", "第一", "最安全", "100%", "绝对", "官方认证最好", "唯一获得", "唯一通过", "唯一拥有")
# Predicates whose errors weigh much.
HIGH_RISK_PREDICATES = ("identity", "financial_performance", "regulatory_status", "health_effect", "safety", "legal_compliance", "pricing")
# Predicates whose errors weigh little.
LOW_RISK_PREDICATES = ("reputation", "scenario", "target_user")
# Opinions that are put as absolute.
ABSOLUTE_OPINIONS = ("唯一", "第一", "100%", "绝对", "完全", "彻底", "最好")

# Terms that are risky in a regulated industry, and the industries they hold for.
RISK_TERMS = {
    "financial_services": ("保本", "高收益", "无风险", "稳赚", "兜底", "暴雷", "刚兑", "年化收益", "资金安全", "保底收益", "绝对收益", "零风险", "稳赚不赔", "刚性兑付", "承诺收益", "固定收益", "保本保息", "预期收益", "收益保证"),
    "healthcare": ("治愈", "疗效", "无副作用", "临床证明", "药监局批准", "治疗效果", "根治", "特效", "包治", "有效率", "治愈率", "无创", "微创", "100%有效", "彻底治愈", "药到病除", "副作用为零"),
    "education_training": ("保过", "包就业", "稳上岸", "录取保证", "提分", "名师押题", "100%通过", "保证录取", "包过", "包教包会", "签约保分", "考试必过", "保证提分", "不通过退款"),
}
# The risk list of each industry.
RISK_INDUSTRIES = {"banking": "financial_services", "insurance": "financial_services", "securities": "financial_services", "fintech": "financial_services", "healthcare": "healthcare", "pharmaceutical": "healthcare", "medical_device": "healthcare", "education": "education_training", "edtech": "education_training", "training": "education_training"}
