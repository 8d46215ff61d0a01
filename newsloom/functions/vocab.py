"""Word lists, tables and weights that results depend on. All are defaults of arguments."""

# ---- fixed values: trust of sources by name, first match in this order (name, tier, score) ----
SOURCE_TRUST = [
    ("Reuters", "gold", 90), ("Bloomberg", "gold", 90), ("New York Times", "gold", 85), ("Financial Times", "gold", 85),
    ("Wall Street Journal", "gold", 85), ("BBC", "gold", 80), ("AP", "gold", 85),
    ("CNN", "silver", 55), ("The Guardian", "silver", 60), ("CNBC", "silver", 60), ("Nikkei Asia", "silver", 60),
    ("Al Jazeera", "silver", 55), ("SCMP", "silver", 55), ("The Hindu", "silver", 55), ("Yonhap", "silver", 55),
    ("Japan Times", "silver", 55), ("Deutsche Welle", "silver", 55), ("France 24", "silver", 55), ("ABC Australia", "silver", 55),
    ("RT", "bronze", 30), ("Sputnik", "bronze", 25), ("TASS", "bronze", 30), ("新华社英文版", "bronze", 35), ("CGTN", "bronze", 30),
    ("环球时报英文版", "bronze", 30), ("Press TV", "bronze", 20), ("ZeroHedge", "bronze", 20),
]
UNRATED = ("unrated", 40)

# ---- fixed values: words of the relevance filter ----
NOISE_WORDS = [
    "celebrity", "football", "soccer", "basketball", "NFL", "NBA", "hiring", "freelance", "internship", "job opening",
    "weather forecast", "lottery", "recipe", "diet tip", "celebrity gossip", "royal baby", "award show", "click here",
    "sponsored", "advertorial", "promoted", "top 10", "you won't believe", "shocking", "viral video", "funny", "cute puppy", "cat video",
]
PRIORITY_WORDS = ["international", "global", "military", "sanction", "crisis", "war", "国际", "外交", "军事", "制裁", "危机"]

# ---- fixed values: event types, regions, phases, levels ----
EVENT_TYPES = {
    "军事冲突": "MILITARY", "军事": "MILITARY", "外交": "DIPLOMATIC", "外交谈判": "DIPLOMATIC", "经济": "ECONOMIC",
    "经济制裁": "ECONOMIC", "制裁": "ECONOMIC", "金融": "FINANCIAL", "金融市场": "FINANCIAL", "科技": "TECH", "科技竞争": "TECH",
    "能源": "ENERGY", "资源": "ENERGY", "政治": "POLITICAL", "选举": "POLITICAL", "社会": "SOCIAL", "自然灾害": "NATURAL", "公共卫生": "HEALTH",
}
REGIONS = ["北美", "欧洲", "亚洲", "中东", "非洲", "南美", "大洋洲", "全球"]
PHASE_TYPES = {"military": "军事", "diplomatic": "外交", "economic": "经济", "financial": "金融", "sanction": "经济"}
SIGNAL_RANK = {"S": 4, "A": 3, "B": 2, "C": 1}
RISK_BASE = {"S": 85, "A": 65, "B": 45, "C": 25}
PHASE_BONUS = {"military": 15, "financial": 10, "sanction": 8, "economic": 5, "diplomatic": 0, "de-escalation": -10}
CONFIDENCE = {"高": 0.9, "中": 0.6, "低": 0.3, "high": 0.9, "medium": 0.6, "low": 0.3}
LEVEL_RATES = {"S": 0.95, "A": 0.90, "B": 0.80, "C": 0.60}
LEVEL_FROM = {"S": 80, "A": 60, "B": 35}
DIMENSIONS = {"government": (0.40, 25, 5), "financial": (0.25, 25, 5), "energy": (0.20, 25, 5), "media": (0.10, 25, 25), "think_tank": (0.05, 5, 2)}
"""dimension -> (weight, cap, points for a hit; for media points for five sources of quality 1)"""
PHASE_RULES = [
    ("military", ["军演", "military", "部署"], ["diplomatic", "sanction", "economic"]),
    ("sanction", ["制裁", "sanction", "禁运"], ["diplomatic", "economic"]),
    ("financial", ["债券", "抛售", "收益率"], ["military", "sanction", "economic"]),
    ("economic", ["经济对抗", "贸易战", "trade war", "economic", "关税", "tariff"], ["diplomatic", "sanction"]),
    ("de-escalation", ["停火", "谈判", "ceasefire"], None),
]
"""(new phase, words, phases it can follow; None: any), tried in this order"""

# ---- fixed values: theme patterns, first match in this order ----
THEMES = [
    (r"霍尔木兹|Hormuz|伊朗.*攻击|伊朗.*袭击|美伊", "霍尔木兹/美伊冲突"),
    (r"南海|South China Sea|COC|行为准则", "南海安全"),
    (r"台海|Taiwan Strait|台湾|Taiwan", "台海态势"),
    (r"AI.*芯片|chip.*export|半导体|semiconductor|ASML|NVIDIA", "AI芯片战"),
    (r"OPEC|油价|oil price|Brent|WTI|原油|石油", "能源价格波动"),
    (r"美联储|Fed |利率|interest rate|通胀|inflation", "全球货币政策"),
    (r"俄乌|Ukraine|乌克兰|Zelensky", "俄乌冲突"),
    (r"金砖|BRICS|去美元|dedollar", "去美元化/金砖"),
    (r"稀土|rare earth|锂矿|lithium|关键矿产|critical mineral", "关键矿产供应链"),
    (r"LNG|天然气|natural gas|能源安全|energy security", "能源安全"),
    (r"关税|tariff|贸易战|trade war|WTO", "贸易摩擦"),
    (r"北约|NATO|峰会|summit", "北约动态"),
    (r"东盟|ASEAN|东南亚|Southeast Asia", "东盟/东南亚"),
    (r"非洲|Africa|Sahel|萨赫勒", "非洲安全与发展"),
    (r"朝鲜|North Korea|朝核|弹道导弹|ballistic", "朝鲜半岛"),
    (r"太空|space|卫星|satellite|反卫星", "太空军事化"),
    (r"网络|cyber|黑客|ransomware|网络攻击", "网络安全"),
]
OTHER_THEME = "其他"

# ---- fixed values: narrative leans by source name, first match in this order ----
LEANS = [
    (
        "偏好西方叙事",
        [
            "cnn", "bbc", "reuters", "nyt", "bloomberg", "guardian", "wsj", "ft", "new york times", "wall street journal",
            "financial times", "ap", "associated press", "washington post"
        ]
    ),
    ("偏好中方叙事", ["新华社", "cgtn", "环球时报", "观察者网", "财新", "scmp", "xinhua", "global times", "china daily", "people's daily"]),
    ("偏好俄方叙事", ["rt", "tass", "sputnik", "ria novosti"]),
]
LOCAL_LEAN = "区域本土视角"

# ---- fixed values: report rules, by language ----
PLACEHOLDERS = {
    "zh": ["待补充", "待确认", "待统计", "待更新", "暂无实时数据", "暂未接入", "市场数据暂未接入", "tbd", "TBD", "N/A", "n/a", "TBC"],
    "en": [
        "to be added", "to be confirmed", "to be updated", "no real-time data", "not available", "market data not available", "pending",
        "tbd", "TBD", "N/A", "n/a", "TBC"
    ],
}
VAGUE = {
    "zh": ["意义重大", "值得关注", "需紧盯", "仍存合作空间", "料持稳偏强", "结构性机会优于系统性机会", "短期可能维持区间震荡", "逼近区间", "密切关注", "不容忽视", "拭目以待"],
    "en": [
        "significant", "worth watching", "keep a close eye", "room for cooperation", "likely to remain stable", "range-bound",
        "structural opportunities outweigh", "approaching the range", "closely monitor", "cannot be ignored", "wait and see"
    ],
}
REPORT_REGIONS = {
    "zh": ["中东", "欧洲", "北美", "亚太", "东南亚", "南亚", "中亚", "中国", "俄罗斯", "非洲", "南美", "大洋洲"],
    "en": [
        "Middle East", "Europe", "North America", "Asia-Pacific", "Southeast Asia", "South Asia", "Central Asia", "China", "Russia",
        "Africa", "South America", "Oceania"
    ],
}
INDICATORS = {"zh": ["标普500", "纳斯达克", "Brent", "WTI", "黄金", "VIX"], "en": ["S&P 500", "Nasdaq", "Brent", "WTI", "Gold", "VIX"]}
REPORT_TITLES = {
    "zh": ("未来48小时关键观察哨", "最高优先级风险", "全量市场数据|核心市场数据"),
    "en": ("48-Hour Key Watchpoints", "Top Priority Risks", "Full Market Data|Market Data"),
}
PLACEHOLDER_URLS = ["xxxx", "example.com/test", "/a-123456"]
DROPPED_QUERY_KEYS = ["utm_", "ceid", "hl", "gl", "fbclid", "gclid"]
