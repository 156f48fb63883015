"""Rule tables as plain data.

Everything in this module is a fixed value: word lists, weights, thresholds and patterns that decide
results. Operators take them as parameters and use these as defaults.
"""

from __future__ import annotations

# ---- category classification (marker hits per category; order breaks ties) ----
CATEGORY_MARKERS: dict[str, list[str]] = {
    "索引與檢索": ["索引", "檢索", "canonical", "robots", "sitemap", "crawl budget", "已檢索未索引", "duplicate", "重複內容"],
    "連結策略": ["backlink", "反向連結", "內部連結", "外部連結", "anchor", "disavow", "錨文字", "link building"],
    "搜尋表現分析": ["ctr", "曝光", "點擊", "排名", "serp", "search console", "impression", "click", "position"],
    "內容策略": ["內容", "title", "meta", "keyword", "關鍵字", "eeat", "topic cluster", "content marketing", "內容策略"],
    "Discover與AMP": ["discover", "amp", "top stories", "焦點新聞"],
    "技術SEO": ["technical seo", "core web vitals", "lcp", "cls", "schema", "structured data", "速度", "https", "hreflang", "pagespeed", "爬蟲"],
    "GA與數據追蹤": ["ga4", "analytics", "事件", "追蹤", "歸因", "session", "工作階段"],
    "平台策略": ["vocus", "自訂網域", "站內搜尋", "方案頁", "平台"],
    "演算法與趨勢": ["algorithm", "核心更新", "helpful content", "ai overview", "ai search", "sge", "chatgpt", "grok", "llmo", "trend", "演算法", "趨勢"],
}
CATEGORY_OTHER = "其他"
DIFFICULTY_ADVANCED = "進階"
DIFFICULTY_BASIC = "基礎"
ADVANCED_MARKERS = [
    "canonical", "robots", "schema", "structured data", "lcp", "cls", "ga4",
    "crawl", "disavow", "hreflang", "api", "embedding", "ai overview", "chatgpt",
]
ADVANCED_MIN_CHARS = 180
TIME_SENSITIVE_MARKERS = [
    "update", "核心更新", "演算法", "ai overview",
    "sge", "study", "research", "experiment", "統計", "研究", "實驗", "trend",
]
YEAR_PATTERN = "20[0-9]{2}"

# ---- rule-based extraction ----
BOILERPLATE_MARKERS = ["notion url", "page id", "建立時間", "最後編輯", "會議日期**"]
EXCERPT_CHARS = 220
SEGMENT_MIN_CHARS = 24
FALLBACK_MIN_CHARS = 40
EXTRACTION_CONFIDENCE = 0.55

# ---- maturity classification ----
MATURITY_L4 = [
    "預測", "predictive", "forecasting", "排名預測", "流量預測", "預測模型",
    "機器學習", "machine learning", "ml model", "跨通路", "跨通路整合", "cross-channel", "omnichannel",
    "歸因分析", "歸因模型", "attribution model", "multi-touch",
    "自動化測試", "seo 自動化測試", "automated testing framework", "regression testing",
    "competitive intelligence", "競爭情報", "競爭情報系統", "程式化 seo", "programmatic seo",
    "增量價值", "incremental value", "知識圖譜", "knowledge graph", "內容生成 pipeline", "content pipeline",
    "推薦系統", "recommendation engine", "citation growth", "引用成長",
    "scenario planning", "情境規劃", "authority building", "decision gates",
]
MATURITY_TREND_TOPICS = [
    "ai overview", "ai overviews", "aio", "ai search", "生成式搜尋", "geo", "generative engine optimization",
    "aeo", "answer engine optimization", "llm seo", "ai 可見度", "ai visibility",
    "ai 驅動", "ai-driven", "ai-powered", "品牌可見度", "brand visibility",
]
MATURITY_AI_SEARCH = [
    "ai overview", "ai overviews", "aio", "ai search", "生成式搜尋", "geo", "generative engine optimization",
    "aeo", "answer engine optimization", "llm seo", "ai 可見度", "ai visibility",
]
MATURITY_L4_STRATEGY = [
    "citation growth", "引用成長", "scenario planning", "情境規劃", "authority building", "decision gates",
    "競爭情報", "competitive intelligence", "site:", "sub-queries", "subqueries", "流量預測", "預測模型",
]
MATURITY_L3 = [
    "a/b test", "a/b 測試", "ab test", "數據分析", "data-driven", "data analysis",
    "自動化", "automation", "automated", "dashboard", "儀表板", "sop", "標準作業", "standard operating",
    "kpi 追蹤", "kpi tracking", "segmentation", "分群", "advanced schema", "進階 schema",
    "log analysis", "日誌分析", "crawl budget", "爬取預算", "api 整合", "api integration",
    "content hub", "內容中心", "entity seo", "實體 seo",
]
MATURITY_L2 = [
    "流程", "process", "workflow", "追蹤", "tracking", "monitor", "指標", "metrics", "kpi",
    "google search console", "gsc", "google analytics", "ga4", "sitemap", "robots.txt",
    "canonical", "hreflang", "內部連結", "internal link", "meta tag", "meta 標籤",
    "schema markup", "結構化資料", "core web vitals", "cwv", "search intent", "搜尋意圖",
    "content calendar", "內容行事曆", "競爭分析", "competitor analysis",
]
MATURITY_L1 = [
    "什麼是", "what is", "基礎", "basic", "beginner", "入門", "如何開始", "how to start", "getting started",
    "seo 是什麼", "seo 定義", "title tag", "標題標籤", "meta description", "關鍵字研究", "keyword research",
    "反向連結", "backlink", "on-page", "頁面優化", "google 索引", "google indexing",
    "seo 工具", "seo tool", "搜尋引擎", "search engine",
]
# each inner list is one phrasing signal, tested on the answer only, in any letter case
MATURITY_ADVANCED_PHRASES = [
    ["分析", "分群", "模型", "框架", "架構", "演算法", "pipeline"],
    ["integrate", "integration", "orchestrat", "automat"],
    ["api", "sdk", "webhook", "endpoint"],
]
MATURITY_BASIC_PHRASES = [
    ["第一步", "首先", "建議先", "可以先"],
    ["簡單來說", "簡而言之", "基本上"],
    ["what is", "定義是"],
]
MATURITY_FORECAST_TERM = "預測"
MATURITY_FORECAST_LOOKALIKES = ["預期", "預設"]

# ---- enrichment labels ----
INTENT_HINTS: dict[str, list[str]] = {
    "diagnosis": ["異常", "下滑", "問題", "診斷", "原因", "why", "根因"],
    "root-cause": ["root cause", "根因", "歸因", "waf", "canonical", "衝突"],
    "implementation": ["如何", "怎麼", "修正", "實作", "設定", "schema", "標記"],
    "measurement": ["ga", "ga4", "gsc", "ctr", "曝光", "點擊", "kpi", "追蹤", "ratio", "share", "佔比"],
    "reporting": ["報告", "週報", "監測", "儀表板", "slice"],
    "platform-decision": ["平台", "策略", "roadmap", "優先", "取捨", "vocus"],
}
SCENARIO_HINTS: dict[str, list[str]] = {
    "discover": ["discover", "探索"],
    "google-news": ["google news", "news", "新聞"],
    "faq-rich-result": ["faq", "rich result", "搜尋外觀"],
    "ga4-attribution": ["ga4", "attribution", "歸因", "unassigned"],
    "author-page": ["/user", "作者頁", "author"],
    "image-seo": ["image", "圖片", "alt", "縮圖"],
    "core-web-vitals": ["core web vitals", "cwv", "lcp", "cls", "行動版", "手機體驗"],
    "video-seo": ["videoobject", "video appearance", "影片", "video"],
    "sitemap-api": ["sitemap", "url inspection", "inspection api", "cms api"],
    "ai-referral-traffic": ["chatgpt", "perplexity", "gemini", "ai 流量", "流量佔比"],
}
CATEGORY_HINTS: dict[str, list[str]] = {
    "技術SEO": [
        "core web vitals", "lcp", "cls", "schema", "結構化資料", "ttfb", "速度", "amp",
        "videoobject", "video appearance", "sitemap", "url inspection", "inspection api",
        "mobile seo", "行動版", "手機", "json-ld",
    ],
    "索引與檢索": ["索引", "coverage", "googlebot", "canonical", "檢索未索引"],
    "搜尋表現分析": ["ctr", "曝光", "點擊", "排名", "serp", "search console", "kpi", "品牌", "非品牌", "brand", "non-brand"],
    "GA與數據追蹤": ["ga", "ga4", "歸因", "事件", "direct", "unassigned", "chatgpt", "perplexity", "gemini", "ratio", "share", "佔比"],
    "Discover與AMP": ["discover", "amp", "news", "探索"],
    "內容策略": ["內容", "文章", "供給", "eeat", "主題", "更新"],
    "連結策略": ["連結", "內部連結", "錨點", "backlink"],
    "平台策略": ["平台", "作者", "路徑", "站內", "vocus", "/user", "cms"],
    "演算法與趨勢": ["演算法", "更新", "ai", "趨勢", "gemini", "perplexity", "chatgpt", "ai overview", "ai search", "llm"],
}
# each rule: (all of these term groups must be hit, categories that it adds)
CATEGORY_CO_RULES: list[tuple[list[list[str]], list[str]]] = [
    ([["discover", "google news", "news", "探索", "amp"]], ["Discover與AMP"]),
    ([["演算法", "update", "趨勢", "ai overview", "ai search", "chatgpt", "gemini", "perplexity", "sge", "discover", "google news"]],
     ["演算法與趨勢"]),
    ([["waf", "googlebot", "canonical", "coverage", "檢索未索引", "sitemap", "url inspection", "inspection api", "索引"]],
     ["索引與檢索", "技術SEO"]),
    ([["ga", "ga4", "gsc", "direct", "referral", "歸因"], ["discover", "amp", "news", "探索"]],
     ["GA與數據追蹤", "Discover與AMP"]),
    ([["轉換率", "conversion", "signups", "註冊"], ["ai search", "ai overview", "chatgpt", "perplexity", "gemini", "ai 流量"]],
     ["搜尋表現分析", "內容策略", "演算法與趨勢"]),
]
GRANULARITY_HINTS: list[tuple[str, list[str]]] = [
    ("tactical", ["步驟", "checklist", "如何", "修正", "設定"]),
    ("diagnostic", ["診斷", "根因", "為什麼", "異常"]),
]
GRANULARITY_DEFAULT = "strategic"
EVIDENCE_HINTS: dict[str, list[str]] = {
    "technical": ["cwv", "schema", "索引", "crawl", "canonical", "技術"],
    "content": ["內容", "文章", "eeat", "主題", "編輯"],
    "analytics": ["ga", "ga4", "gsc", "曝光", "點擊", "ctr", "session"],
    "platform": ["平台", "作者", "路徑", "ia", "產品"],
}
LOW_CONFIDENCE_NEGATIVES = ["無關", "不適用", "誤判"]

# ---- query label hints (search side) ----
QUERY_INTENT_HINTS: dict[str, list[str]] = {
    "diagnosis": ["異常", "下滑", "原因", "診斷", "why", "根因"],
    "root-cause": ["root cause", "根因", "canonical", "waf", "衝突"],
    "implementation": ["如何", "修正", "設定", "實作", "schema", "標記"],
    "measurement": ["ga", "ga4", "gsc", "ctr", "曝光", "點擊", "追蹤", "kpi", "ratio", "share", "佔比"],
    "reporting": ["報表", "週報", "監測", "趨勢"],
    "platform-decision": ["平台", "策略", "路徑", "作者"],
}
QUERY_SCENARIO_HINTS: dict[str, list[str]] = {
    "discover": ["discover", "探索"],
    "google-news": ["google news", "news", "新聞"],
    "faq-rich-result": ["faq", "rich result", "搜尋外觀"],
    "ga4-attribution": ["ga4", "歸因", "unassigned"],
    "author-page": ["/user", "作者頁", "author"],
    "image-seo": ["image", "圖片", "alt", "縮圖"],
    "core-web-vitals": ["core web vitals", "cwv", "lcp", "cls", "行動版", "手機體驗"],
    "video-seo": ["videoobject", "video appearance", "影片", "video"],
    "sitemap-api": ["sitemap", "url inspection", "inspection api", "cms api"],
    "ai-referral-traffic": ["chatgpt", "perplexity", "gemini", "ai 流量", "流量佔比"],
}
QUERY_CATEGORY_HINTS: dict[str, list[str]] = {
    "技術SEO": [
        "schema", "結構化資料", "core web vitals", "lcp", "cls", "ttfb", "amp", "videoobject", "video appearance",
        "sitemap", "url inspection", "inspection api", "mobile seo", "行動版", "手機", "json-ld",
    ],
    "索引與檢索": ["索引", "coverage", "googlebot", "canonical", "檢索未索引"],
    "搜尋表現分析": ["ctr", "曝光", "點擊", "serp", "search console", "kpi", "品牌", "非品牌", "brand", "non-brand"],
    "GA與數據追蹤": ["ga", "ga4", "追蹤", "歸因", "direct", "chatgpt", "perplexity", "gemini", "ratio", "share", "佔比"],
    "Discover與AMP": ["discover", "amp", "news"],
    "內容策略": ["內容", "文章", "eeat", "供給", "更新"],
    "連結策略": ["連結", "內部連結", "錨點"],
    "平台策略": ["平台", "作者", "/user", "路徑", "cms"],
    "演算法與趨勢": ["演算法", "趨勢", "ai", "gemini", "perplexity", "chatgpt", "ai overview", "ai search", "llm"],
}

# ---- search weights ----
SEMANTIC_WEIGHT = 0.7
KEYWORD_HIT = 0.1
KEYWORD_PARTIAL_SHARE = 0.5
KEYWORD_MAX_HITS = 3.0
SYNONYM_BONUS = 0.05
OVER_RETRIEVE = 3
PHRASE_FACTOR = 2.0
SURFACE_TOKEN = 0.03
CATEGORY_OVERLAP = 0.08
INTENT_OVERLAP = 0.06
SCENARIO_OVERLAP = 0.05
EXACT_TERM = 0.04
TIER_CANONICAL = 0.08
TIER_SUPPORTING = 0.02
TIER_BOOSTER_HIT = 0.05
TIER_BOOSTER_MISS = -0.08
HARD_NEGATIVE = -0.05
METADATA_TEXT_CHARS = 2000
METADATA_TOKENS = 100
MATURITY_BOOST = 1.15
GATE_CORRECT = 0.6
GATE_AMBIGUOUS = 0.4

# ---- metric sheets and alerts ----
CELL_ERRORS = ["#N/A", "#DIV/0!", "#REF!", "#VALUE!", ""]
SHEET_HEADER_MARKS = ["月趨勢", "上週"]
SKIP_METRICS = ["Sparklines", "#N/A", ""]
CORE_METRICS = [
    "曝光", "點擊", "CTR", "有效 (Coverage)", "檢索未索引", "工作階段總數（七天）", "Organic Search (工作階段)",
    "Discover", "AMP (non-Rich)", "AMP Article", "Google News", "News(new)", "Image",
]
ALERT_MONTHLY = 0.15
ALERT_WEEKLY = 0.20
HEALTH_LABELS = ("良好", "需關注", "警示")

# ---- segment sheets ----
SEGMENT_ADVICE: list[tuple[str, str]] = [
    ("/article/", "文章頁是核心內容資產。檢查是否有重複/薄內容被 Google 判定低品質，優先合併或補充深度內容。"),
    ("/tag/", "Tag 頁面常因內容稀薄被判定為低品質。考慮 noindex 低流量 tag 頁，或為高流量 tag 補充策展內容。"),
    ("/en/", "多語系路徑。確認 hreflang 設定正確、canonical 未衝突，避免被視為重複內容。"),
    ("/post", "檢查文章是否有足夠獨特內容。若與 /article/ 重疊，確認 canonical 設定避免自我競爭。"),
    ("/salon/", "UGC（使用者生成內容）路徑。高未索引率可能源自內容品質不一，考慮設定品質門檻或 noindex 低品質頁面。"),
    ("/user/", "使用者個人頁面通常內容稀薄。建議 noindex 處理，將爬蟲資源集中在高價值內容頁。"),
]
SEGMENT_ADVICE_CRITICAL = "此路徑未索引率劇增，立即在 GSC → 索引 → 網頁中篩選此路徑，檢查「已檢索 — 目前未建立索引」的具體 URL。"
SEGMENT_ADVICE_IMPROVING = "此路徑狀況改善中，持續監控確認趨勢穩定。"
SEGMENT_ADVICE_DEFAULT = "定期檢查此路徑的索引狀態，確認無異常波動。"

# ---- character classes ----
HAN_CLASS = "\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff"
CJK_CLASS = HAN_CLASS + "\\u3040-\\u309f\\u30a0-\\u30ff\\uac00-\\ud7af"

# ---- report scoring ----
REPORT_SECTIONS_BASIC = ["## 一、", "## 二、", "## 三、", "## 四、", "## 五、", "## 六、"]
REPORT_SECTIONS = REPORT_SECTIONS_BASIC + ["## 七、"]
RESEARCH_KEYWORDS = ["Backlinko", "Semrush", "NavBoost", "First Page Sage", "arxiv", "SEOCausal", "CausalImpact", "E-E-A-T"]
KB_LINK = r"/admin/[A-Za-z]+/(?:[0-9a-f]{16}|\d+)"
REPORT_METRICS = [
    "CTR", "曝光", "點擊", "排名", "索引", "Discover", "CLS", "LCP", "FID", "INP", "Core Web Vitals", "反向連結", "外部連結", "內部連結",
    "跳出率", "停留時間", "轉換率", "流量", "有機搜尋", "AI Overview", "檢索未索引", "收錄", "爬取", "網頁速度", "Position", "E-E-A-T",
    "佔比", "覆蓋率",
]
CAUSAL_CONNECTORS = ["導致", "因此", "因為", "表示", "意味著", "這表示", "這意味", "由於", "造成", "然而", "但", "儘管", "雖然", "進而", "以致", "所以", "反映", "顯示", "源自", "歸因"]
SPECIFIC_ACTIONS = (
    r"在\s*(?:GSC|Search Console|PageSpeed|Chrome|Screaming Frog|Ahrefs|Semrush)|篩選|檢查|驗證|使用\s*\S+\s*(?:面板|報表|工具)|部署後\s*\d+|設定\s*\S+"
    r"|加入\s*\S+|移除\s*\S+|重寫|優化\s*(?i:title|標題|description|meta)|補上|修復|排查|測試"
)
QUADRANT_KEYWORDS = ["高曝光低點擊", "低曝光高點擊", "高曝光高點擊", "低曝光低點擊"]
QUADRANT_SIGNALS = ["建議", "表示", "因為", "利基", "優勢", "需要", "應該", "代表", "意味"]
TOP_REASONS = ["雖然", "因為", "理由", "原因", "而", "但", "相比", "優先"]
NUMBER_EVIDENCE = r"(?U)[+-]?\d+(?:\.\d+)?%|\b\d{1,3}(?:,\d{3})+\b|\b\d{3,}\b"
WEEK_PERCENT = r"週.*?[+-]?\d+(?:\.\d+)?%|[+-]?\d+(?:\.\d+)?%.*?週"
MONTH_PERCENT = r"月.*?[+-]?\d+(?:\.\d+)?%|[+-]?\d+(?:\.\d+)?%.*?月"
MATURITY_LABEL = r"\[(?:策略|流程|關鍵字|指標)\s*L[1-4]→L[1-4]\]"
MATURITY_REFERENCE = "成熟度參考"
COMPOSITE_V2 = {"overall": 0.30, "cross_metric": 0.15, "action_specificity": 0.15, "data_evidence": 0.12, "citation_integration": 0.10, "quadrant": 0.10, "depth_balance": 0.08}
COMPOSITE_V2_JUDGED = {
    "overall": 0.20, "cross_metric": 0.10, "action_specificity": 0.10, "data_evidence": 0.08, "citation_integration": 0.07, "quadrant": 0.05, "depth_balance": 0.05,
    "reasoning_depth": 0.15, "actionability": 0.10, "insight_originality": 0.10,
}
JUDGE_COLUMNS = ["reasoning_depth", "actionability", "insight_originality"]
JUDGE_TOP = 5
# names that reports give to a source, and the source
SOURCE_ALIASES = {
    "search engine land": "searchengineland", "searchengineland": "searchengineland", "sel": "searchengineland",
    "search engine roundtable": "seroundtable", "seroundtable": "seroundtable", "ser": "seroundtable",
    "search engine journal": "searchenginejournal", "searchenginejournal": "searchenginejournal", "sej": "searchenginejournal",
    "google developers": "google-developers", "google search central": "google-search-central", "google search central 官方公告": "google-search-central",
}
BROAD_TERMS = ["CTR", "曝光", "索引", "AMP", "Discover", "工作階段"]
COMPOSITE_V3 = {
    "overall": 0.12, "cross_metric": 0.15, "action_specificity": 0.15, "data_evidence": 0.09, "citation_integration": 0.08, "quadrant": 0.07, "depth_balance": 0.10,
    "dual_frame": 0.07, "causal_chain": 0.06, "priority_balance": 0.05, "maturity_labeled": 0.04, "top_recommendation": 0.02,
}
PREP_SECTIONS = [
    "Section 0：執行摘要", "Section 1：本週異常地圖", "Section 2：業界最新動態", "Section 3：深度根因假設", "Section 4：顧問視角交叉比對", "Section 5：五層審計缺口清單",
    "Section 6：E-E-A-T 現況評估", "Section 7：人本七要素分析", "Section 8：SEO 成熟度自評", "Section 9：會議提問清單", "Section 10：會議後行動核查表",
]
PREP_QUESTION_RANGES = {"A": (3, 5), "B": (4, 6), "C": (2, 3), "D": (2, 3)}
PREP_QUESTION_TAG = r"\[(?:NEW|CARRY(?:-W\d+)?|Updated|Validated|Discarded|TS-[A-Z]+|\d+)\]"
PREP_LEVEL = r"L[1-4](?:\.\d)?"
PREP_DIMENSIONS = [("strategy", "策略"), ("process", "流程"), ("keywords", "關鍵字"), ("metrics", "指標")]
PREP_METRIC_PATTERN = (
    r"Discover|CTR|AMP\s*(?:Article|Ratio)?|Coverage|外部連結|回應時間|KW[:：「]\s*\S+|營運\s*KW[:：「]\s*\S+|檢索未索引|探索比例|"
    r"結構化\s*Ratio|新網頁|/salon/|/article/|/en/|/tag/|Organic\s*Search|News\s*\(new\)|Video|GPT|Gemini|Perplexity|AI\s*占比"
)
PREP_TOOLS = "(?i)GSC|Search Console|PageSpeed|Ahrefs|Screaming Frog|GA4|Google Trends|Semrush|Moz|Chrome DevTools|Lighthouse"
PREP_VERBS = "排查|篩選|檢查|驗證|監控|建立|設定|測試|分析|規劃|導入"
PREP_SECTION_CATEGORIES = {
    "3": ["技術SEO", "索引與檢索", "連結策略", "演算法與趨勢", "Discover與AMP", "搜尋表現分析"],
    "6": ["技術SEO", "Discover與AMP", "連結策略", "搜尋表現分析", "演算法與趨勢"],
}
VALIDATION_SECTIONS = ["一、", "二、", "三、", "四、", "五、", "六、", "七、"]
SEGMENT_SEVERITY_WORDS = ["警示", "嚴重", "需關注", "穩定", "改善", "🔴", "🟡", "🟢"]
SEGMENT_ACTION_WORDS = ["GSC", "canonical", "noindex", "robots", "hreflang", "合併", "檢查", "建議", "行動"]
SEGMENT_UP_WORDS = ["上升", "增加", "惡化", "+"]
SEGMENT_DOWN_WORDS = ["下降", "減少", "改善", "-"]
CRAWLER_BOTS = ["GPTBot", "ChatGPT-User", "ClaudeBot", "anthropic-ai", "Google-Extended", "Bytespider", "PerplexityBot", "Applebot-Extended", "cohere-ai", "Meta-ExternalAgent"]

# ---- fixed values: topics that every report searches for, after those of its metrics ----
REPORT_TOPICS = ["CTR 下降 改善", "索引覆蓋 問題", "Discover 演算法", "爬蟲 抓取"]

# ---- fixed values: Chinese numerals of section headings, by number ----
HAN_NUMERALS = ["〇", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十"]
