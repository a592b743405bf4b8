"""Fixed values that results depend on; they are data, stated as they are."""

# English and Chinese stop words.
STOP_WORDS_EN = (
    "the a an of in on at to for and or is are was were be been being have has had do does did will would could should may might "
    "this that these those it its with from by as but not no so if than too very can about up out how what which who when where "
    "why all each every both few more most other some such only own same just also new like into over after before between through during"
).split()
STOP_WORDS_ZH = (
    "的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 "
    "那 些 个 为 与 对 中 等 能 将 被 从 让 把 给 做 用 比 更 已 或"
).split()

# Terms that raise a cluster's importance. SOTA never matches lower-cased text; that is kept.
HIGH_SIGNAL = (
    "release launch announce breakthrough first record acquire acquisition merger benchmark SOTA open-source regulation ban restrict "
    "发布 推出 首次 突破 收购 合并 开源 禁止 限制 监管"
).split()

# Source authority, first match wins.
AUTHORITY = [
    ("openai.com", 1.0), ("anthropic.com", 1.0), ("ai.google", 1.0), ("deepmind.google", 1.0), ("ai.meta.com", 1.0), ("arxiv.org", 1.0), ("blog.google", 1.0), ("research.google", 1.0),
    ("techcrunch.com", 0.7), ("theverge.com", 0.7), ("wired.com", 0.7), ("arstechnica.com", 0.7), ("github.com", 0.7), ("huggingface.co", 0.7), ("venturebeat.com", 0.7), ("theinformation.com", 0.7),
    ("36kr.com", 0.7), ("jiqizhixin.com", 0.7), ("机器之心", 0.7), ("量子位", 0.7), ("infoq.cn", 0.7),
]

# Subject keywords.
AI_KEYWORDS_ZH = [
    "人工智能", "AI", "大模型", "LLM", "机器学习", "深度学习", "神经网络", "GPT", "Claude", "Gemini", "大语言模型", "Transformer", "AGI", "AIGC", "生成式", "智能体", "Agent", "RAG", "微调",
    "训练", "推理", "开源模型", "闭源模型", "多模态", "文生图", "文生视频", "语音识别", "NLP", "计算机视觉", "强化学习", "芯片", "GPU", "TPU", "算力", "AI芯片", "英伟达", "NVIDIA",
]
AI_KEYWORDS_EN = [
    "AI", "artificial intelligence", "LLM", "GPT", "Claude", "Gemini", "machine learning", "deep learning", "neural network", "transformer", "AGI", "AIGC", "generative", "agent", "RAG", "fine-tun",
    "inference", "open-source model", "multimodal", "text-to-image", "text-to-video", "NLP", "computer vision", "reinforcement learning", "GPU", "TPU", "AI chip", "NVIDIA", "deepseek", "anthropic",
    "openai", "google ai", "meta ai", "copilot", "chatbot",
]

# Categories in order, and the older names of some.
CATEGORIES = [
    ("ai_ml", "AI/ML", "🧠 AI 研究前沿"), ("tech_general", "综合科技", "💻 科技与 AI 综合"), ("ai_tools", "AI 工具", "🛠️ AI 工具与应用"), ("tech_product", "科技产品", "📱 科技产品"), ("general_news", "综合新闻", "🌍 综合新闻"),
    ("chips_hardware", "芯片硬件", "🔧 芯片硬件"), ("cloud", "云计算", "☁️ 云计算"), ("open_source", "开源", "📂 开源"), ("cybersecurity", "网络安全", "🔒 网络安全"), ("hacker_news", "Hacker News", "🔥 Hacker News 热门"),
    ("podcast", "播客", "🎙️ 播客更新"), ("wechat_security", "安全", "🛡️ 微信·安全"), ("wechat_dev", "开发", "💻 微信·开发"), ("wechat_other", "其他", "📱 微信·其他"), ("wechat_user", "用户提交", "👤 微信·用户提交"),
]
OLD_CATEGORIES = {
    "ai_research": "ai_ml", "tech_ai": "tech_general", "安全": "wechat_security", "开发": "wechat_dev", "其他": "wechat_other", "用户提交": "wechat_user",
    "AI/ML": "ai_ml", "综合科技": "tech_general", "芯片硬件": "chips_hardware", "云计算": "cloud", "开源": "open_source", "网络安全": "cybersecurity", "Hacker News": "hacker_news",
}
DIRECT_CATEGORIES = ("ai_ml", "ai_tools")

# Query parameters that only track, for the two url forms.
TRACKING_PATTERN = "utm_[a-z]+|ref|source|fbclid|gclid|mc_eid|campaign|medium|content|term"
TRACKING_NAMES = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "source", "from", "fbclid", "gclid")

# Phrases of a review that asks for no change.
NO_CHANGE = ("无需修改", "核查通过", "无问题发现", "no changes needed", "verified", "no issues found", "looks good", "no revision", "no corrections", "quality is high", "no problems")

# Named entities replaced before a feed is parsed.
ENTITIES = {"nbsp": " ", "mdash": "—", "ndash": "–", "copy": "©", "reg": "®", "laquo": "«", "raquo": "»", "hellip": "…", "ldquo": '"', "rdquo": '"'}

# Statuses of requests that fail, the exceptions and the phrases of messages by which they are known; the first that fits.
TIMED_OUT, UNKNOWN_ERROR = -2, -1
ERRORS = [
    (TIMED_OUT, ("TimeoutError",), ("timed out", "timeout")),
    (-3, (), ("getaddrinfo", "name or service not known", "nodename", "name resolution")),
    (-4, ("ConnectionRefusedError", "ConnectionResetError", "BrokenPipeError"), ("connection refused", "connection reset", "broken pipe")),
    (-5, (), ("ssl", "certificate", "cert", "hostname")),
]

# Parts of urls that are not fetched for their text.
SKIPPED_URLS = ("twitter.com", "x.com", "reddit.com", "youtube.com", "facebook.com", "linkedin.com", "instagram.com", "paywalled.", "subscribe.", "login.", "accounts.")

# Classes of divisions that hold a page's main text.
CONTENT_CLASSES = ("post-content", "article-body", "entry-content", "td-post-content", "article-text", "story-body", "post-body", "content-body", "article__body", "main-content", "post-entry")

# Tags that end a line of plain text, and tags whose text is left out.
BLOCK_TAGS = "p div br li h1 h2 h3 h4 h5 h6 blockquote tr ul ol table hr section article".split()
SKIPPED_TAGS = "style script".split()

# Forms of video urls, in order.
VIDEO_FORMS = ("(?:v=|/v/|youtu\\.be/)([\\w-]{11})", "(?:embed/)([\\w-]{11})", "(?:shorts/)([\\w-]{11})")
VIDEO_HOSTS = ("youtube.com", "youtu.be")

# An account article's category and host, a podcast episode's path.
ACCOUNT_CATEGORY, ACCOUNT_HOST, EPISODE_PATH = "wechat_", "mp.weixin.qq.com", "xiaoyuzhoufm.com/episode/"
EPISODE_URL = "https://www.xiaoyuzhoufm.com/episode/"
ACCOUNT_CATEGORIES = ("wechat_security", "wechat_dev", "wechat_other", "wechat_user")

# Markers of an account article's body and of what follows it.
BODY_MARKS = ('id="js_content"', 'class="rich_media_content"')
BODY_ENDS = ('id="js_pc_close_btn"', 'class="rich_media_tool"', 'id="js_tags"')

# Words of a report's footer, labels of a summary, the bullet of related reports.
FOOTER_WORDS = ("生成时间", "Generated")
SUMMARY_LABELS = ("^为什么重要[：:]\\s*", "^Why it matters:\\s*")
REASONS = ("篇相关报道", "多源验证", "权威来源", "高新闻价值", "值得关注")
POINTS_REASON = ("HN ", "赞")

# Labels of fetch errors by code.
ERROR_LABELS = {-1: "未知错误", -2: "超时", -3: "DNS解析失败", -4: "连接被拒绝/重置", -5: "SSL错误"}

# A model's settings by task.
TASK_PROFILES = {
    "classify": (0.1, 0.9, 2000), "topic_cluster": (0.2, 0.9, 2000), "tldr": (0.3, 0.9, 500), "critique": (0.3, 0.9, 1000),
    "summarize": (0.5, 0.9, 4000), "deep_analysis": (0.7, 0.9, 6000), "wechat_structure": (0.5, 0.9, 4000),
}

# Words of reports by language.
LABELS = {
    "zh": {
        "count": "条", "articles": "篇", "article": "文章", "source": "来源", "summary": "摘要", "stats": "热度", "point": "要点", "category": "分类",
        "points_table": "Hacker News 热门", "highlights": "🔥 今日重点", "why": "为什么重要", "must": "⭐ 必读", "note": "📰 值得关注", "brief": "简讯", "executive": "📋 今日要闻", "insight": "今日趋势洞察",
        "daily": "AI 科技日报", "ai_made": "篇文章 · {n} 个分类 · 🤖 AI 智能摘要", "checked": "共检查 {checked} 个信息源 · {hours}h 窗口 · 发现 {n} 条更新", "footer": "报告生成时间", "tiered_footer": "报告生成时间",
        "part2": "# Part II: 💻 科技动态 ({n} 条)", "top_news": "### ⭐ 重点科技新闻", "verified": " [多源验证]", "part1": "# Part I: 🤖 AI 深度日报 ({n} 篇)", "listing": "### 🤖 AI 相关文章",
        "contents": "## 📑 目录", "time": "> 🕐 生成时间 {time} UTC", "unified": "> 🤖 AI 深度分析 {ai} 篇 · 💻 科技动态 {other} 条 · 共 {n} 篇", "unified_time": "> ⏰ 生成时间 {time} UTC",
        "title": "人工智能技术日报", "title_line": "> {date} · 共 {n} 篇 · AI 自动生成", "key_points": "今日要点", "in_depth": "深度解读", "refs": "参考", "tech": "科技动态", "more": "- ……等 {n} 条", "closing": "*{title} · AI 自动生成 · 每日更新*",
    },
    "en": {
        "count": "items", "articles": "articles", "article": "Article", "source": "Source", "summary": "Summary", "stats": "Stats", "point": "Key Point", "category": "Category",
        "points_table": "Hacker News Trending", "highlights": "🔥 Today's Highlights", "why": "Why it matters", "must": "⭐ Must Read", "note": "📰 Noteworthy", "brief": "Brief", "executive": "📋 Today's Highlights", "insight": "Today's Trend Insights",
        "daily": "AI Tech Daily", "ai_made": "articles · {n} categories · 🤖 AI-powered", "checked": "Checked {checked} sources · {hours}h window · found {n} updates", "footer": "Report generated at", "tiered_footer": "Generated at",
        "part2": "# Part II: 💻 Tech Updates ({n} items)", "top_news": "### ⭐ Top Tech News", "verified": "", "part1": "# Part I: 🤖 AI Deep Digest ({n} articles)", "listing": "### 🤖 AI-Related Articles",
        "contents": "## 📑 Table of Contents", "time": "> 🕐 Generated at {time} UTC", "unified": "> 🤖 AI Deep Analysis {ai} articles · 💻 Tech Updates {other} items · Total {n}", "unified_time": "> ⏰ Generated at {time} UTC",
        "title": "AI Technology Daily", "title_line": "> {date} · {n} articles · AI generated", "key_points": "Highlights", "in_depth": "In Depth", "refs": "Refs", "tech": "Tech Updates", "more": "- ……等 {n} 条", "closing": "*{title} · AI generated · Daily updates*",
    },
}
PODCAST_LABELS = ("播客更新汇总", "> 🎙️ 共检查 {checked} 个播客 · {hours}h 窗口 · 发现 {n} 个更新", "| # | 节目 | 播客 | 排名 | 摘要 |", "内容暂无")
ACCOUNT_LABELS = ("微信公众号更新汇总", "> 📱 共检查 {checked} 个公众号 · {hours}h 窗口 · 发现 {n} 条更新", "| # | 文章 | 公众号 | 摘要 |", "*报告生成时间: {time} UTC*")
OTHER_CATEGORY, OTHER_THEME, BRIEF_UNIT = "其他", "其他 AI 动态", "条"

# Names of an article's parts in prompts, and headings of tiers there.
PROMPT_PARTS = {"source": "来源", "link": "链接", "summary": "摘要", "kind": "来源类型", "text": "正文片段", "transcript": "视频字幕", "podcast": "播客", "episode": "单集", "notes": "节目简介", "account": "公众号", "article": "文章", "none": "无新文章", "about": "篇关于"}
PROMPT_TIERS = ("=== ⭐ 必读 (Must Read) — 最重要的 AI 动态 ===", "=== 📰 值得关注 (Noteworthy) — 重要更新与研究 ===", "=== 📋 简讯 (Brief) — 常规更新 ===")

# The transcript service's address and the environment's name for its key.
TRANSCRIPT_URL, TRANSCRIPT_KEY = "https://api.supadata.ai/v1/transcript", "SUPADATA_API_KEY"

# Mark of a transcript that was cut.
TRANSCRIPT_CUT = "...[已截断]"

# Files of the catalogues; others are read as the first.
CATALOGUES = {"tech": "tech_feeds.json", "podcast": "podcast_feeds.json", "wechat": "wechat_feeds.json"}
