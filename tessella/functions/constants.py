"""Word lists, patterns and limits that results depend on."""

# Stop words of search terms.
SEARCH_STOPWORDS = (
    "และ", "หรือ", "ของ", "ที่", "ใน", "จาก", "กับ", "เป็น", "ให้", "ได้", "มาก", "แล้ว",
    "what", "when", "where", "which", "with", "have", "this", "that", "ค่ะ", "ครับ",
)
# Words that mark a chunk with facts.
FACT_KEYWORDS = (
    "รายได้", "กำไร", "ขาดทุน", "ยอดขาย", "มูลค่า", "งบ", "สัดส่วน", "เติบโต", "อัตรา", "ร้อยละ", "เปอร์เซ็นต์",
    "ล้าน", "พันล้าน", "บาท", "ปี", "ไตรมาส", "yoy", "qoq",
    "revenue", "profit", "loss", "sales", "earnings", "growth", "percent", "market", "budget", "cost",
)
# Words that send a question to the structured store.
STRUCTURED_SIGNALS = (
    "จำนวนพนักงาน", "พนักงาน", "employees", "employee", "รายได้", "revenue", "กำไร", "profit", "สินทรัพย์", "assets",
    "หนี้สิน", "liabilities", "เท่าไหร่", "กี่คน", "ตัวเลข", "เปอร์เซ็นต์", "%", "มีอะไรบ้าง", "อะไรบ้าง", "what are the", "which are the", "list",
)
# Fact keys and the words that ask for them, in order of precedence.
KEY_WORDS = (
    ("employees", ("พนักงาน", "employees", "employee")),
    ("revenue", ("รายได้", "revenue")),
    ("profit", ("กำไร", "profit", "net income", "net_income")),
    ("assets", ("สินทรัพย์", "assets")),
    ("liabilities", ("หนี้สิน", "liabilities")),
)
LIST_WORDS = ("มีอะไรบ้าง", "อะไรบ้าง")
TREND_WORDS = ("เทรนด์", "trend")
# Words that ask for a numbered list of trends.
LIST_REQUESTS = ("มีอะไรบ้าง", "ตอบเป็นรายการ", "1-5", "1–5", "1-8", "1–8")
# Words that ask for a definition or a figure.
DETAIL_WORDS = ("คืออะไร", "หมายถึงอะไร", "บอกอะไรเกี่ยวกับ", "เท่าไร", "เท่าไหร่", "ตัวเลข", "ช่วงเวลา", "%", "ปี")
# Words that ask for one article.
SINGLE_ARTICLE_WORDS = ("บทความ", "บทความนี้", "ข่าวนี้", "หน้านี้", "ในบทความ", "ในข่าว")
# Words that ask for a number.
NUMERIC_WORDS = ("ปี", "%", "สัดส่วน", "ตัวเลข", "ช่วงเวลา", "เท่าไร", "เท่าไหร่", "คาดการณ์", "how much")
# Words that carry no phrase of a question.
PHRASE_NOISE = (
    "ในบทความ", "บทความนี้", "ข่าวนี้", "หน้านี้", "คืออะไร", "เท่าไร", "เท่าไหร่", "ถูกคาดว่า", "ตัวเลข", "ช่วงเวลา", "อะไร", "และ", "หรือ", "จาก",
)
# Words of a question and the phrases they add.
SYNONYMS = (
    (("สูงวัย", "ผู้สูงอายุ", "elderly", "senior"), ("ผู้สูงอายุ", "สังคมผู้สูงอายุ", "สูงวัย")),
    (("pet parent", "สัตว์เลี้ยง", "pet"), ("pet parent", "ตลาดสัตว์เลี้ยง", "สัตว์เลี้ยง")),
    (("พลังงานสะอาด", "พลังงานหมุนเวียน", "clean energy", "renewable"), ("พลังงานสะอาด", "พลังงานหมุนเวียน", "ลดคาร์บอน")),
    (("สังคมไร้เงินสด", "cashless", "cross-border", "การค้าออนไลน์"), ("สังคมไร้เงินสด", "การค้าออนไลน์ข้ามพรมแดน", "cashless")),
)
# Words of chunks that are no content.
BOILERPLATE_SIGNALS = (
    "คุกกี้", "cookie", "privacy", "นโยบายความเป็นส่วนตัว", "subscribe", "notifications", "sponsored", "undo", "อ่านเพิ่มเติม", "powered by", "taboola",
)
LATE_WEB_SIGNALS = ("amarin tvundo", "sponsored")
# Families of lines that are no content.
BOILERPLATE_LINES = (
    ("cookie", "consent", "privacy", "terms", "นโยบาย", "คุกกี้", "ความเป็นส่วนตัว", "ข้อกำหนด"),
    ("subscribe", "newsletter", "ติดตาม", "สมัครรับข่าวสาร"),
    ("share", "แชร์", "follow us", "ติดตามเรา"),
    ("log in", "login", "sign in", "register", "สมัครสมาชิก", "เข้าสู่ระบบ"),
    ("advert", "advertisement", "sponsor", "โฆษณา"),
)
BLOCK_KEYWORDS = ("imperva", "security check", "hcaptcha", "verify you are human", "access denied", "cloudflare", "captcha")
IGNORED_IMAGES = ("logo", "icon", "sprite", "button", "spacer", "blank", "pixel", "avatar", "badge", "placeholder")
FILE_URL_WORDS = (".pdf", "getmedia", "download", "attachment", "file", "/getmedia/", ".pdf.aspx")
# Image types and the caption words that show them, in order of precedence.
IMAGE_TYPES = (
    ("chart", ("chart", "graph", "plot", "bar chart", "line chart", "pie chart")),
    ("table", ("table", "spreadsheet")),
    ("document", ("document", "paper", "report", "invoice", "slide", "presentation")),
    ("logo", ("logo",)),
    ("people", ("person", "people", "man", "woman", "portrait", "face")),
    ("infographic", ("infographic",)),
)
KEPT_IMAGE_TYPES = ("chart", "table", "document", "infographic")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
TERMINAL_STAGES = ("done", "error", "not_found")
WORKFLOW_STAGES = ("queued", "scrape", "caption", "ocr", "ocr_summary", "ingest", "report", "done", "error")
# Classes and ids of page elements that are no content.
JUNK_CLASSES = (
    "nav", "navbar", "menu", "header", "footer", "aside", "sidebar", "widget", "breadcrumb", "cookie", "consent", "popup", "modal", "overlay", "banner",
    "subscribe", "newsletter", "share", "social", "follow", "comment", "remark", "related", "recommend", "tag", "topic", "ads", "advert", "sponsor",
    "promotion", "promo", "brand", "login", "register", "search", "pagination", "pager", "toolbar", "sticky", "floating",
)

# Limits.
CHUNK_CHARS, CHUNK_OVERLAP = 900, 120
EMBED_CHARS, EMBED_OVERLAP = 5000, 200
MIN_CHUNK_CHARS = 100
TOPIC_SIMILARITY = 0.85
MIN_SCORE = 0.01
CONTEXT_CHARS, SNIPPET_CHARS = 8500, 7000
FACT_CHARS, FACT_MIN_CHARS, FACT_CHUNKS = 4500, 120, 10
LOG_ENTRIES = 5000
# Namespaces in the order in which they are asked.
NAMESPACES = ("internal", "external")
# Heading of an answer from facts, with the blank line after it.
FACTS_HEADING = "คำตอบจาก Structured RAG (ข้อเท็จจริง):\n"
# Route of an answer from a web search, and what is said where there is none.
SEARCH_ROUTE = "tavily_fallback"
NO_SEARCH_NOTE = "\n\nหมายเหตุ: Tavily ใช้งานไม่ได้ (%s) จึงตอบจาก RAG เท่าที่มี"
NOTHING_FOUND = "ไม่พบข้อมูลเพียงพอใน RAG และ Tavily ใช้งานไม่ได้: %s"
SEARCH_WITHOUT_MODEL = "สรุปไม่ได้ด้วย LLM ในตอนนี้ แต่พบผลค้นหา Tavily:\n\n"
# Words by which a question about an article asks for trends' impact, approaches, figures, lists, actions or roles.
EACH_TREND = ("แต่ละเทรนด์", "ทั้ง 5 เทรนด์", "ทั้งห้าเทรนด์")
IMPACTS = ("โอกาส", "ความเสี่ยง", "ควรทำ")
APPROACHES = ("business approach", "แนวทางธุรกิจ", "แบบ bullet")
ARTICLE_FIGURES = ("ตัวเลข", "สถิติ", "การคาดการณ์", "แหล่งไหน", "แหล่งที่มา")
ASKS_LIST = ("อะไรบ้าง", "ขอรายการ", "หัวข้อย่อย", "bullet", "รายการ")
ASKS_ACTIONS = ("แนวทาง", "ไอเดียธุรกิจ", "สินค้า", "บริการ", "เทคโนโลยี", "ควรทำ", "แนะนำ")
ASKS_ROLE = ("บทบาท", "คืออะไร", "อย่างไร", "นิยาม", "หมายถึง")
ASKS_STATS = ("ตัวเลข", "สถิติ", "การคาดการณ์", "เท่าไร", "เท่าไหร่", "%", "ปี")
ASKS_ARTICLE = ("บทความ", "เทรนด์", "ตัวเลข", "แนวคิด", "ไอเดีย", "บริการ", "ธุรกิจ")
# Lines of answers from an article.
CHANCE, CHANCE_NONE = "โอกาส: ", "บทความชี้ว่ามีโอกาสเติบโตตามเทรนด์นี้"
TO_DO, TO_DO_NONE = "สิ่งที่ควรทำ: ", "บทความไม่ได้ระบุแนวทางเพิ่มเติม"
RISK = "ความเสี่ยง: บทความไม่ได้ระบุโดยตรง; หากไม่ปรับตัวอาจเสียโอกาสทางการแข่งขัน"
PET_PARENT = "pet parent"
PET_PARENT_LINE = "Pet Parent ในบทความหมายถึง สัตว์เลี้ยงยังคงถูกมองเป็นส่วนหนึ่งของครอบครัว และมีแนวโน้มที่ครอบครัวจะมีสัตว์เลี้ยงเป็นสมาชิกเพิ่มขึ้นเรื่อย ๆ"
AI_LINE = "บทความบอกว่า AI/Automation จะมีบทบาทกับธุรกิจปี 2025 โดย "
LEAD_LINE, LEAD_IS = "บทความระบุว่า ", " คือ "
THE_ARTICLE, NO_SOURCE_NAMED = "บทความ", "บทความไม่ได้ระบุชื่อแหล่งใน section นี้"
NOT_IN_ARTICLE = "ไม่พบข้อมูลที่ถามไว้โดยตรงในบทความนี้"
