"""Words, terms and patterns of the default lexicon. Callers may pass their own Lexicon."""

from __future__ import annotations

from dataclasses import dataclass, field

# English stop words.
EN_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "if", "in", "into", "is",
    "it", "its", "of", "on", "or", "that", "the", "their", "to", "was", "we", "were", "with", "you", "your", "i",
    "me", "my", "our", "they", "them", "this", "these", "those", "not", "no", "yes", "can", "could", "should",
    "would", "will", "just", "also", "about", "how", "what", "why", "when", "where", "which", "who", "whom", "more",
    "most", "less", "least", "like", "may", "time", "information", "value", "one", "two", "three", "four", "five",
    "six", "seven", "eight", "nine", "ten", "first", "second", "third", "new", "please", "thanks", "thank", "using",
    "used", "useful", "make", "made", "get", "got", "here", "key", "keys", "provide", "provided", "provides", "out",
    "app",
]

# Chinese stop words.
ZH_STOPWORDS = [
    "的", "了", "是", "我", "你", "他", "她", "它", "我们", "你们", "他们", "她们", "它们", "在", "有", "和", "与", "或", "以及", "并", "但",
    "而", "就", "也", "还", "很", "非常", "一个", "这个", "那个", "这些", "那些", "如果", "因为", "所以", "为什么", "如何", "什么", "怎么", "什么样",
    "例如", "比如", "问题", "分钟", "小时", "时间", "以下", "是什么", "信息", "好的", "因此", "同时", "一下", "一些", "一个人", "这种", "那种", "还有",
    "以及", "这里", "那里", "就是", "不会", "可以", "需要", "应该", "可能", "现在", "之前", "之后", "因为", "所以", "然后", "这样", "那样",
]

# Terms that are noise wherever they stand, and short ones that are not.
NOISE_TERMS = [
    "null", "text", "file", "content", "content_type", "expiry_datetime", "asset_pointer", "metadata", "direction",
    "decoding_id", "audio", "video", "tool_audio_direction", "search_query", "response_length", "textdoc_id",
    "loaded", "turn", "cite", "navlist", "news", "com", "www", "nan", "image", "user", "team", "group", "all",
    "only", "use",
]
SHORT_ALLOWED = ["ai", "ml", "gpt"]

# Terms that never are keywords, and endings of identifiers.
KEYWORD_BLACKLIST = [
    "ts", "tsx", "js", "jsx", "json", "yml", "yaml", "md", "html", "css", "svg", "png", "jpg", "jpeg", "webp",
    "gif", "const", "let", "var", "import", "export", "return", "async", "await", "function", "class", "interface",
    "type", "extends", "implements", "public", "private", "protected", "props", "state", "node_modules", "vite",
    "babel", "webpack", "eslint", "prettier",
]
IDENTIFIER_ENDINGS = ["Service", "Panel", "Dashboard", "Interface", "Provider", "Controller", "Manager"]

# What a term is shown as.
TERM_ALIASES = {
    "ai": "AI", "gpt": "GPT", "llm": "LLM", "openai": "OpenAI", "gemini": "Gemini", "claude": "Claude",
    "deepseek": "DeepSeek", "prompt": "提示词", "prompts": "提示词", "embedding": "向量", "embeddings": "向量",
    "fine-tune": "微调", "finetune": "微调", "transformer": "Transformer", "transformers": "Transformer", "人工智能": "AI",
    "大模型": "大模型", "机器学习": "机器学习", "深度学习": "深度学习", "提示词": "提示词", "investment": "投资", "invest": "投资",
    "investing": "投资", "portfolio": "投资组合", "stock": "股票", "stocks": "股票", "equity": "股权", "bond": "债券",
    "bonds": "债券", "etf": "ETF", "etfs": "ETF", "option": "期权", "options": "期权", "future": "期货", "futures": "期货",
    "finance": "金融", "financial": "金融", "trading": "交易", "trade": "交易", "market": "市场", "markets": "市场",
    "risk": "风险", "returns": "收益", "yield": "收益", "volatility": "波动", "drawdown": "回撤", "valuation": "估值",
    "nasdaq": "纳斯达克", "sp500": "标普500", "s&p": "标普", "ibkr": "盈透", "data": "数据", "dataset": "数据", "理财": "理财",
    "投资": "投资", "基金": "基金", "股票": "股票", "债券": "债券", "期权": "期权", "期货": "期货", "资产配置": "资产配置", "资本市场": "资本市场",
    "市盈率": "市盈率", "现金流": "现金流", "typescript": "TypeScript", "javascript": "JavaScript", "python": "Python",
    "react": "React", "firebase": "Firebase", "github": "GitHub", "vscode": "VSCode", "cursor": "Cursor",
    "sql": "SQL",
}

# Keywords that come first among hot terms.
PINNED_KEYWORDS = [
    "投资", "理财", "基金", "股票", "债券", "ETF", "AI", "GPT", "MBA", "编程", "开发", "运动", "睡眠",
]

# Topics in order of priority, with the terms that speak for them.
TOPIC_RULES = [
    ("投资理财", [
        "投资", "理财", "基金", "股票", "债券", "ETF", "期权", "期货", "资产配置", "收益", "风险", "回撤", "估值", "市盈率", "现金流", "资本市场", "金融",
        "交易", "纳斯达克", "标普500", "盈透", "美股", "港股", "A股", "比特币", "加密",
    ]),
    ("编程开发", [
        "代码", "编程", "开发", "前端", "后端", "数据库", "API", "Python", "JavaScript", "TypeScript", "React", "Firebase",
        "GitHub", "Cursor", "VSCode", "SQL", "Docker", "调试", "报错", "部署", "测试",
    ]),
    ("AI/大模型", [
        "AI", "GPT", "LLM", "大模型", "机器学习", "深度学习", "提示词", "向量", "微调", "OpenAI", "Gemini", "Claude", "Transformer",
    ]),
    ("职场管理", [
        "MBA", "OKR", "管理", "领导力", "职场", "职业", "面试", "简历", "团队", "沟通", "汇报",
    ]),
    ("学习教育", [
        "学习", "课程", "作业", "论文", "考试", "申请", "学校", "大学", "留学", "课表", "学分", "项目", "study", "course", "assignment",
        "exam", "university",
    ]),
    ("出行旅行", [
        "旅行", "行程", "路线", "攻略", "机票", "航班", "酒店", "签证", "租车", "景点", "travel", "flight", "hotel", "visa",
        "itinerary",
    ]),
    ("生活服务", [
        "租房", "住房", "房东", "保险", "医疗", "银行", "税务", "购物", "餐厅", "交通", "手机", "居住", "生活", "service", "insurance",
        "rent", "housing", "tax",
    ]),
    ("健康运动", [
        "运动", "跑步", "健身", "训练", "睡眠", "咖啡", "咖啡因", "血压", "血脂", "减脂", "心率", "营养", "HIIT",
    ]),
    ("软件工具", [
        "Mac", "Windows", "Chrome", "Obsidian", "Figma", "Cursor", "VSCode", "GitHub", "代理", "网络",
    ]),
]
OTHER_TOPIC = "其他"

# Chinese terms that are always in the vocabulary.
DOMAIN_TERMS = [
    "投资", "理财", "基金", "股票", "债券", "期权", "期货", "回撤", "估值", "市盈率", "现金流", "资产配置", "资本市场", "纳斯达克", "标普500", "美股", "港股",
    "A股", "加密", "比特币", "大模型", "提示词", "机器学习", "深度学习", "前端", "后端", "数据库", "调试", "报错", "部署", "测试", "咖啡因", "血压", "血脂",
    "心率", "留学", "课程", "考试", "机票", "航班", "签证", "租房", "保险",
]

# Keys of tool calls, content types that are metadata, substrings of build noise.
TOOL_KEYS = ["search_query", "response_length", "path", "args", "tool_calls", "tool", "function", "call"]
METADATA_TYPES = ["app_pairing_content", "reasoning_recap", "thoughts", "user_editable_context"]
BUILD_NOISE = ["node_modules", "@babel/parser", "<vite-error-overlay", "plugin:vite"]

# Patterns of a list's marks, of a line that begins like one, of file names, and of what tools call things.
LIST_PREFIX = r"(?U)^\s*(?:[-*•]|\d+[.、])\s*"
LIST_START = r"(?U)^\s*(?:[-*•]|\d+[\\.、)])"
FILE_TOKEN = r"(?iU)\b[\w./-]+\.(?:ts|tsx|js|jsx|py|md|json|yml|yaml|css|html|go|rs|java|cpp|c|h)\b"
TURN_NAME = r"^turn\p{Nd}+(?:search|news|view|file|calc|code|media)\p{Nd}+$"
SHORT_NAME = r"^[a-z]{1,2}\p{Nd}{1,4}$"
NUMBERED_NAME = r"^[a-z]{1,3}\p{Nd}{3,}$"

# Cues, as alternatives of a regular expression that ignores case.
HIGHLIGHT_CUES = "结论|总结|要点|建议|策略|风险|行动|下一步|计划|目标|决定|复盘|洞察|insight|summary|conclusion|recommend|next step|action|risk|decision"
REQUEST_CUES = "请|帮我|帮忙|如何|怎么|为什么|能否|可否|请问|怎么做|how|what|why|can you|could you"
CONTEXT_CUES = "背景|情况|我现在|我目前|我在|我是|我的|目标|需求|现状|因为|场景|计划|打算"
CONSTRAINT_CUES = "预算|限制|必须|不要|不想|至少|最多|以内|以上|不超过|不高于|不低于|prefer|limit|budget|must|only"
UNITS = "元|美元|￥|¥|%|小时|分钟|天|周|月|年|km|公里|m|mb|gb|k|w|万|usd|rmb|dollar|day|hour|min"
FEEDBACK_CUES = "不对|错误|更正|调整|修改|改成|再|继续|太长|太短|不够|不太|不满意|优化|精简|补充|不是|改一下"
BOUNDARY_CUES = "无法|不能|不支持|不便|不会|我不能|我无法|无法访问|无法浏览|没有实时|不具备|无法提供|as an ai|i can't|i cannot|i don't have access|i do not have access"
CLARIFY_CUES = "请提供|需要更多|能否提供|请补充|还需要|更多信息|具体一点|进一步说明"

# Strengths and gaps of the interaction report (label, metric, threshold).
STRENGTHS = [
    ("问题表达清晰", "clarity_avg", 0.55),
    ("善于提供约束条件", "constraint_rate", 0.3),
    ("提供背景信息", "context_rate", 0.3),
    ("愿意迭代反馈", "feedback_rate", 0.12),
    ("多轮推进问题", "iteration_rate", 0.4),
]
GAPS = [
    ("问题表述偏简略", "clarity_avg", 0.45, False),
    ("约束条件不足", "constraint_rate", 0.25, False),
    ("背景信息偏少", "context_rate", 0.25, False),
    ("反馈/迭代不足", "feedback_rate", 0.1, False),
    ("追问频率偏低", "iteration_rate", 0.25, False),
    ("AI 需要补充信息", "clarification_rate", 0.2, True),
]
QUOTE_LABELS = [
    ("clarity", "清晰提问"),
    ("constraint", "给出约束"),
    ("context", "补充背景"),
    ("feedback", "迭代反馈"),
    ("vague", "问题偏简略"),
]
BOUNDARY_LABEL = "能力边界提示"


@dataclass(frozen=True)
class Lexicon:
    """The word lists that the term operators use."""

    en_stop: list[str] = field(default_factory=lambda: EN_STOPWORDS)
    zh_stop: list[str] = field(default_factory=lambda: sorted(set(ZH_STOPWORDS)))
    noise: list[str] = field(default_factory=lambda: NOISE_TERMS)
    short_allowed: list[str] = field(default_factory=lambda: SHORT_ALLOWED)
    blacklist: list[str] = field(default_factory=lambda: KEYWORD_BLACKLIST)
    aliases: dict[str, str] = field(default_factory=lambda: TERM_ALIASES)
    pinned: list[str] = field(default_factory=lambda: PINNED_KEYWORDS)
    topics: list[tuple[str, list[str]]] = field(default_factory=lambda: TOPIC_RULES)
    domain: list[str] = field(default_factory=lambda: DOMAIN_TERMS)


DEFAULT = Lexicon()
