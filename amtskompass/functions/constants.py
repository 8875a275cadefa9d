"""Vocabularies, dimension rows and rule lists.

Everything in this module is a fixed value of the catalogue's data model.  The
results of the classifiers and selectors depend on these exact texts, so they
are spelled out in their natural order and kept in one place.  Logic lives in
the sibling modules.
"""

# --- fixed values: enumerations -------------------------------------------------
FEDERAL = "联邦"
REGION_LEVELS = ["联邦", "州", "市", "Landkreis"]
POLICY_STATUSES = ["draft", "published", "unpublished", "expired"]
RISK_LEVELS = ["low", "medium", "high"]
QUEUE_STATUSES = ["pending", "processing", "done", "failed", "skipped"]
QUEUE_SOURCE_TYPES = ["policy", "job"]
RUN_MODES = ["backfill", "recent", "resume"]
RUN_STATUSES = ["running", "paused", "completed", "failed"]
REVIEW_STATUSES = [
    "ok", "needs_update", "source_changed", "source_unreachable", "not_policy", "uncertain",
]
REVIEW_ACTIONS = ["keep", "update", "unpublish", "manual_check"]
MAX_ATTEMPTS = 3
UNKNOWN_TEXT = "未查到"
UNDATED_LABEL = "未注明"

# --- fixed values: dimensions ---------------------------------------------------
CATEGORIES = [
    "居留与签证", "留学与大学", "工作与蓝卡", "入籍与长期居留", "税务与社保", "医保与保险",
    "家庭与福利", "交通与驾照", "宠物与犬税", "生活行政", "招聘信息", "其他",
]
INGEST_CATEGORIES = [
    "居留与签证", "留学与大学", "工作与蓝卡", "入籍与长期居留", "税务与社保", "医保与保险",
    "家庭与福利", "交通与驾照", "宠物与犬税", "生活行政", "其他",
]
OTHER_CATEGORY = "其他"
TARGET_GROUPS = [
    "留学生", "求职者", "工作签人群", "蓝卡人群", "自雇人士",
    "华人家庭", "新移民", "车主", "宠物主人", "可能相关",
]
DEFAULT_GROUP = "可能相关"
STATE_CODES = {
    "Baden-Württemberg": "BW", "Bayern": "BY", "Berlin": "BE", "Brandenburg": "BB",
    "Bremen": "HB", "Hamburg": "HH", "Hessen": "HE", "Mecklenburg-Vorpommern": "MV",
    "Niedersachsen": "NI", "Nordrhein-Westfalen": "NW", "Rheinland-Pfalz": "RP",
    "Saarland": "SL", "Sachsen": "SN", "Sachsen-Anhalt": "ST",
    "Schleswig-Holstein": "SH", "Thüringen": "TH",
}
WORK_TYPES = {"vz": "全职", "tz": "兼职", "ho": "远程", "mj": "迷你岗", "aa": "实习"}
JOB_TAGS = [
    "需要中文", "无语言要求", "英语即可", "留学生适合", "华人优先", "无经验可", "远程可选",
    "迷你岗", "实习岗", "可办工作签证", "IT/技术", "餐饮/酒店", "零售/销售", "制造/物流",
    "金融/会计", "教育/培训", "医疗/护理", "行政/文员", "市场/传媒", "工程/技术",
    "家政/服务", "客服/前台",
]

# --- fixed values: region aliases (first match wins) ----------------------------
# (name, state, level, pattern over the lookup-normalised region text)
REGION_ALIASES = [
    ("Stuttgart", "Baden-Württemberg", "市", "stuttgart|斯图加特"),
    ("Landkreis Ludwigsburg", "Baden-Württemberg", "Landkreis", "ludwigsburg|路德维希堡"),
    ("Baden-Württemberg", "Baden-Württemberg", "州", "baden[- ]?w|巴登|符腾堡|符騰堡"),
    ("Bayern", "Bayern", "州", "bayern|bavaria|巴伐利亚|巴伐利亞"),
    ("Berlin", "Berlin", "州", "berlin|柏林"),
    ("Hessen", "Hessen", "州", "hessen|hessian|黑森"),
    ("Schleswig-Holstein", "Schleswig-Holstein", "州",
     "schleswig[- ]?holstein|石勒苏益格|荷尔斯泰因"),
]
FEDERAL_NEEDLES = ["deutschland", "bund", "联邦"]
DISCLAIMER_PATTERNS = [
    "不涉及.{0,36}(居留|签证|移民|税务|工作|法律|权益|专业建议)[^。.!?]*",
    "不构成.{0,36}(法律|税务|移民|专业建议)[^。.!?]*",
]

# --- fixed values: display category rules (first match wins) --------------------
DISPLAY_CATEGORY_RULES = [
    ("入籍与长期居留", ["入籍", "国籍", "永居", "长期居留", "永久居留", "naturalization",
                 "einbürger", "niederlassung"]),
    ("居留与签证", ["签证", "居留", "外管局", "aufenthalt", "ausländer", "residence permit",
               "蓝卡申请"]),
    ("工作与蓝卡", ["蓝卡", "工作签", "就业", "求职", "雇员", "工人", "jobcenter", "arbeits",
               "employment"]),
    ("留学与大学", ["大学", "高校", "学生签", "留学", "注册", "学校", "教育", "kita", "schule",
               "student", "university"]),
    ("医保与保险", ["医保", "医疗", "医院", "护理", "急救", "保险", "health", "kranken", "pflege",
               "rettungsdienst"]),
    ("家庭与福利", ["家庭", "儿童", "父母", "子女", "托儿", "幼儿", "福利", "儿童金", "父母金",
               "庇护", "无家可归", "familien", "kind", "kinder"]),
    ("税务与社保", ["税", "社保", "费用", "财政", "预算", "纳税", "steuer", "gebühr", "haushalt"]),
    ("交通与驾照", ["交通", "驾照", "驾驶", "车辆", "停车", "公交", "自行车", "道路", "隧道", "出行",
               "verkehr", "führerschein", "straße", "tunnel"]),
    ("宠物与犬税", ["宠物", "犬税", "动物", "猫", "狗", "爬行", "蛇", "hund", "reptil"]),
    ("生活行政", ["预约", "登记", "市民服务", "办事", "公共服务", "住房", "租房", "供水", "警报",
              "数字化", "行政", "wohnen", "bürger", "verwaltung"]),
]

# --- fixed values: ingest category rules (differ from the display rules) --------
INGEST_CATEGORY_RULES = [
    ("入籍与长期居留", ["入籍", "国籍", "永居", "长期居留", "naturalization", "einbürger",
                 "niederlassung"]),
    ("居留与签证", ["签证", "居留", "外管局", "aufenthalt", "ausländer"]),
    ("工作与蓝卡", ["蓝卡", "工作签", "就业", "求职", "jobcenter", "arbeits", "employment"]),
    ("留学与大学", ["大学", "高校", "学生", "留学", "注册", "学校", "kita", "schule", "student",
               "university"]),
    ("医保与保险", ["医保", "医疗", "医院", "护理", "急救", "保险", "health", "kranken", "pflege",
               "rettungsdienst"]),
    ("家庭与福利", ["家庭", "儿童", "父母", "子女", "托儿", "幼儿", "福利", "儿童金", "父母金",
               "庇护", "无家可归", "familien", "kind", "kinder"]),
    ("税务与社保", ["税", "社保", "费用", "财政", "预算", "纳税", "steuer", "gebühr", "haushalt"]),
    ("交通与驾照", ["交通", "驾照", "驾驶", "车辆", "停车", "公交", "自行车", "道路", "隧道", "出行",
               "verkehr", "führerschein", "straße", "tunnel"]),
    ("宠物与犬税", ["宠物", "犬税", "动物", "猫", "狗", "爬行", "蛇", "hund", "reptil"]),
    ("生活行政", ["预约", "登记", "市民服务", "办事", "公共服务", "住房", "租房", "供水", "警报",
              "数字化", "行政", "wohnen", "bürger", "verwaltung"]),
]

# --- fixed values: target group rules -------------------------------------------
GROUP_RULES = [
    ("留学生", ["学生", "大学", "高校", "学校", "留学", "student", "schule", "university"]),
    ("求职者", ["求职", "招聘", "就业", "jobcenter", "arbeitslos", "bewerbung"]),
    ("工作签人群", ["工作签", "雇员", "就业", "工人", "arbeits", "employment"]),
    ("蓝卡人群", ["蓝卡", "blue card", "blaue karte"]),
    ("自雇人士", ["自雇", "创业", "自由职业", "企业主", "freiberuf", "startup"]),
    ("华人家庭", ["家庭", "儿童", "父母", "子女", "幼儿", "kita", "kind", "familie"]),
    ("新移民", ["新移民", "外籍", "移民", "居留", "入籍", "ausländer", "aufenthalt"]),
    ("车主", ["车主", "驾驶", "驾照", "车辆", "停车", "隧道", "道路", "机动车", "verkehr",
            "führerschein", "tunnel"]),
    ("宠物主人", ["宠物", "犬", "动物", "爬行", "蛇", "猫", "狗", "hund", "reptil"]),
]
BLUE_CARD_NEEDLES = ["蓝卡", "blue card", "blaue karte"]
CATEGORY_GROUPS = {
    "留学与大学": "留学生",
    "入籍与长期居留": "新移民",
    "居留与签证": "新移民",
    "家庭与福利": "华人家庭",
    "交通与驾照": "车主",
    "宠物与犬税": "宠物主人",
}
WORK_CATEGORY, BLUE_CARD_GROUP, WORK_VISA_GROUP = "工作与蓝卡", "蓝卡人群", "工作签人群"

# --- fixed values: job tag rules (all matches, in this order) -------------------
JOB_TAG_RULES = [
    ("需要中文", ["chinesisch", "chinese", "mandarin", "中文", "中国业务", "中国相关"]),
    ("无语言要求", ["ohne sprachkenntnisse", "keine sprachkenntnisse", "kein deutsch",
               "no german", "ohne sprach"]),
    ("英语即可", ["englisch", "english", "gute englisch", "good english", "englische"]),
    ("留学生适合", ["werkstudent", "student", "studium", "praktikum", "ausbildung", "学生",
               "实习生", "兼职"]),
    ("华人优先", ["chinesischsprachig", "china-", "chinesische"]),
    ("无经验可", ["ohne berufserfahrung", "berufseinsteiger", "einsteiger", "quereinsteiger",
              "无经验", "无需经验"]),
    ("远程可选", ["homeoffice", "remote", "fernarbeit", "mobiles arbeiten", "von zu hause",
              "远程", "居家"]),
    ("迷你岗", ["geringfügig", "538 euro", "450 euro", "minijob", "迷你"]),
    ("实习岗", ["praktikum", "ausbildungs", "intern", "实习"]),
    ("可办工作签证", ["arbeitnehmererlaubnis", "visum", "工作签证", "工作许可"]),
    ("IT/技术", ["it-", "software", "developer", "programmier", "it-support", "datenbank",
               "cloud", "aws", "python", "java", "javascript", "sql", "linux", "docker",
               "kubernetes", "devops", " Fullstack", "frontend", "backend", "web-entwickler",
               "IT", "计算机", "软件", "开发"]),
    ("餐饮/酒店", ["gastronomi", "hotel", "restaurant", "koch", "bedienung", "餐饮", "酒店",
               "厨师", "服务员"]),
    ("零售/销售", ["verkauf", "verkäufer", "einzelhandel", "retail", "kundenberatung", "销售",
               "零售", "营业员"]),
    ("制造/物流", ["produktion", "lager", "logistik", "fertigung", "制造", "物流", "仓库",
               "生产线"]),
    ("金融/会计", ["buchhaltung", "finanz", "bank", "steuer", "会计", "金融", "财务", "银行"]),
    ("教育/培训", ["bildung", "schule", "lehre", "ausbild", "教育", "培训", "学校", "教师"]),
    ("医疗/护理", ["gesundheit", "pflege", "medizin", "krankenhaus", "医疗", "护理", "护士",
               "医院"]),
    ("行政/文员", ["büro", "verwaltung", "sekretär", "administr", "行政", "文员", "办公室",
               "内勤"]),
    ("市场/传媒", ["marketing", "medien", "kommunikation", "content", "市场", "传媒", "营销",
               "广告"]),
    ("工程/技术", ["ingenieur", "techniker", "technisch", "engineering", "工程", "技术员"]),
    ("家政/服务", ["reinigung", "reinig", "haushalt", "服务", "清洁", "家政"]),
    ("客服/前台", ["kundenservice", "rezeption", "callcenter", "hotline", "客服", "前台",
               "接线员"]),
]

# --- fixed values: work type detection in job details ---------------------------
FULL_TIME_NEEDLES = ["vollzeit", "vollzeitstelle", "vollzeitbeschäftigung"]
PART_TIME_NEEDLES = ["teilzeit", "teilzeitstelle", "teilzeitbeschäftigung", "Nachmittag",
                     "Vormittag"]
REMOTE_NEEDLES = ["heimarbeit", "homeoffice", "remote", "fernarbeit", "mobiles arbeiten"]

# --- fixed values: feed relevance -----------------------------------------------
FEED_KEYWORDS = [
    "gesetz", "gesetzes", "gesetzgebung", "verordnung", "satzung", "richtlinie", "reform",
    "förderprogramm", "förderung", "zuschuss", "gebühr", "beitrag", "steuer", "miete",
    "mietspiegel", "wohngeld", "bürgergeld", "bafög", "einbürger", "aufenthalt", "migration",
    "integration", "ausländerbehörde", "antrag", "online-antrag", "antragsverfahren",
    "pflicht", "anspruch", "verbot", "regelung", "neue regeln", "änderung", "klima",
    "energie", "heizung", "solar", "verkehr", "führerschein", "ticket",
]
FEED_EXCLUDED = [
    "empfängt", "besuch", "gedenken", "wettbewerb", "statement", "telefonat", "glückwunsch",
    "olympia", "ausstellung", "konzert", "feiert", "iran", "ukraine", "krieg",
    "waffenruhe", "botschafter", "nato", "sicherheitsrat", "beschlagnahmt",
    "privatwohnung", "reptilien", "giftige kobra", "waran",
]
FEED_PATH_SUFFIXES = [
    "/feed", "/rss", "/rss.xml", "/atom.xml", "/presse/rss", "/presse/rss.xml",
    "/service/rss", "/service/rss.xml", "/de/service/rss", "/de/presse/rss",
]

# --- fixed values: page extraction ----------------------------------------------
GUIDE_URL_SKIPS = [
    "ueber-uns", "kontakt", "presse", "stellenangebot", "praktikum", "barrierefreiheit",
    "impressum", "datenschutz", "erklaerung", "downloads", "tipps-fuer-rechtsanwaelte",
    "leitung-organisation", "oeffentliche-zustellungen", "verpflichtungserklaerung",
]
MIGRATION_OFFICE_BOILERPLATE = [
    "^Source:", "^©", "^Date:", "^Format:", "^Area:", "^This content is also available in",
    "^Make it in Germany", "^Link to the information hotline", "^Go to:", "^You are here:",
]
MIGRATION_OFFICE_CONTAINERS = ["c-language-switch", "l-intro-media", "c-meta", "aural"]
FOREIGN_OFFICE_BOILERPLATE = [
    "^©", "^Copyright", "^Share this page", "^Federal Foreign Office$", "^Content$",
    "^We hope you understand", "^Breadcrumbs", "^More languages",
    "^Report an accessibility problem",
]
FOREIGN_OFFICE_NAV_WORDS = [
    "visa & service", "visa information", "living in germany", "help desk",
    "consular information", "faq", "visa navigator",
]
CONSUMER_NAV_WORDS = ["zurück", "weiter", "mehr dazu", "alle anzeigen", "teilen"]
CONSUMER_BLOCK_WORDS = ["cookie", "zustimmung", "einwilligung", "teilen", "facebook", "twitter"]
EXCHANGE_NOISE_PHRASES = [
    "ANSCHRIFT", "DAAD NEWSLETTER", "NÜTZLICHE LINKS", "Servicenavigation",
    "Links zu den Sozialen Medien", "Impressum", "Datenschutzerklärung", "Cookies",
    "Erklärung Barrierefreiheit", "Barriere melden", "Gebärdensprache", "Leichte Sprache",
    "Farbumschalter", "Colour switch",
]
CONTACT_NEEDLES = [
    "friedrich-krause", "ufer", "berlin", "telefon", "fax", "email", "sprechzeit",
    "öffnungszeit", "servicezeit",
]
FEE_PATTERNS = [r"(\d+[\.,]?\d*)\s*(€|euro|eur)", "gebühren?pflichtig", "gebühren?",
                "kostenlos"]
DURATION_PATTERNS = [
    r"(\d+)\s*(woche|monat|tag|jahr|wochen|monaten|tagen|jahren)", "bearbeitungszeit", "dauer",
]

# --- fixed values: office topics and titles (ordered, first match wins) ---------
OFFICE_TOPIC_RULES = [
    ("签证与入境", ["visum", "einreise"]),
    ("工作与蓝卡", ["erwerb", "arbeit", "fachkraft"]),
    ("留学与大学", ["studium", "student"]),
    ("入籍与长期居留", ["unbefristet", "niederlassung"]),
    ("入籍与长期居留", ["einbürgerung", "einbuergerung"]),
    ("居留与签证", ["befristet", "familie", "familien"]),
    ("居留与签证", ["elektronisch", "eAT"]),
    ("居留与签证", ["erlosch"]),
    ("居留与签证", ["freizugig", "eu"]),
    ("家庭与福利", ["gefluchtet"]),
    ("生活行政", ["termin"]),
    ("生活行政", ["beratung", "service"]),
    ("工作与蓝卡", ["business"]),
]
OFFICE_TOPIC_DEFAULT = "居留与签证"
OFFICE_TITLES = [
    ("einreise", "入境"), ("visumverfahren", "签证程序"), ("kurzer aufenthalt", "短期停留 (90天内)"),
    ("längerer aufenthalt", "长期居留"), ("visum verlängern", "签证延期"), ("aufenthalt", "居留"),
    ("befristet", "有限期居留"), ("erwerbstätigkeit", "工作居留"), ("studium", "留学居留"),
    ("unbefristet", "永久居留"), ("erloschen", "居留许可失效"), ("elektronischer", "电子居留证 (eAT)"),
    ("freizugigkeit", "欧盟自由迁徙权"), ("gefluchtete", "难民信息"), ("einbürgerung", "入籍"),
    ("service", "服务"), ("beratung", "咨询"), ("business immigration", "商业移民服务"),
    ("online-formulare", "在线表格"), ("beschleunigtes", "快速专业人才程序"), ("termine", "预约"),
    ("termin vereinbaren", "预约办理"),
]
# (url key, German title, Chinese title, topic); the first key contained in the url wins
KEYED_OFFICE_PAGES = [
    ("auslaenderbehoerde", "Hamburg Amt für Migration", "汉堡外管局", "居留与签证"),
    ("allgemeine-verwaltung", "Allgemeine Verwaltung", "综合管理", "生活行政"),
    ("zentrale-auslaenderangelegenheiten", "Zentrale Ausländerangelegenheiten",
     "外国人事务中心", "居留与签证"),
    ("einbuergerungsangelegenheiten", "Einbürgerungsangelegenheiten", "入籍事务",
     "入籍与长期居留"),
    ("erstaufnahme", "Erstaufnahme und Asylbewerberleistungen", "首次接收与难民福利", "家庭与福利"),
    ("rechtsangelegenheiten", "Rechtsangelegenheiten", "法律事务", "居留与签证"),
]

# --- fixed values: consumer guide pages: (page name, category, tags, groups) ----
GUIDE_PAGES = [
    ("einkommensteuer", "税务与社保", ["税务", "报税", "个人所得税"],
     ["新移民", "工作签人群", "求职者", "自雇人士"]),
    ("steuererklaerung", "税务与社保", ["税务", "报税", "退税"],
     ["新移民", "工作签人群", "求职者", "自雇人士"]),
    ("steuerklasse", "税务与社保", None, None),
    ("krankenversicherung", "医保与保险", ["医疗保险", "公立保险", "私立保险"],
     ["新移民", "工作签人群", "留学生"]),
    ("haftpflichtversicherung", "生活行政", ["责任险", "保险", "家庭保险"], ["新移民", "华人家庭"]),
    ("rechtsschutzversicherung", "生活行政", ["法律险", "保险", "法律保护"],
     ["新移民", "工作签人群", "华人家庭"]),
    ("wohngeld", "住房与租房", ["住房补贴", "住房", "政府补助"], ["新移民", "留学生", "求职者"]),
    ("kindergeld", "育儿与教育", ["儿童金", "育儿", "家庭福利"], ["华人家庭"]),
    ("elterngeld", "育儿与教育", ["父母金", "育儿", "产假", "家庭福利"], ["华人家庭"]),
    ("girokonto", "生活行政", ["银行账户", "转账账户", "理财"], ["新移民", "留学生", "工作签人群"]),
    ("kreditkarte", "生活行政", ["信用卡", "支付", "理财"], ["新移民", "留学生", "工作签人群"]),
]
GUIDE_PAGE_DEFAULT_GROUPS = ["新移民"]

# --- fixed values: city fee rows: (city, first, extra, url) ---------------------
CITY_FEES = [
    ("Berlin", "€120/年", "€180/年", "https://allaboutberlin.com/guides/dog-ownership"),
    ("Munich", "€100/年", "€160/年",
     "https://stadt.muenchen.de/service/info/hundesteuer/1033101/"),
    ("Hamburg", "€96/年", "€144/年", "https://www.hamburg.de/hundesteuer/"),
    ("Frankfurt", "€156/年", "€312/年",
     "https://frankfurt.de/themen/ordnung/hundehaltung/hundesteuer"),
    ("Cologne", "€156/年", "€312/年",
     "https://www.stadt-koeln.de/service/lebenslagen/hundehaltung/hundesteuer-anmeldung/"),
    ("Stuttgart", "€108/年", "€216/年", "https://www.stuttgart.de/service/hundesteuer/"),
    ("Düsseldorf", "€108/年", "€162/年",
     "https://www.duesseldorf.de/ordnungsamt/hundehaltung/hundesteuer.html"),
    ("Leipzig", "€96/年", "€192/年",
     "https://www.leipzig.de/buergerservice/dienstleistungen/hundesteuer"),
    ("Dresden", "€120/年", "€240/年",
     "https://www.dresden.de/de/rathaus/dienstleistungen/hundesteuer.php"),
    ("Nürnberg", "€108/年", "€156/年",
     "https://www.nuernberg.de/internet/hundehaltung/hundesteuer.html"),
]

# --- fixed values: default texts of drafts and reviews --------------------------
DRAFT_KEY_CHANGES = ["请以官方原文为准。"]
DRAFT_USER_NOTES = "该内容由 AI 根据官方来源初步整理，发布前需要人工核对官方原文。"
DRAFT_IMPACT = "可能影响相关地区或主题下的居民、申请人或机构，具体适用性以官方说明为准。"
REVIEW_DONE_SUMMARY = "AI 复核完成。"
REVIEW_FAILED_SUMMARY = "AI 复核未能完成，请稍后重试或检查官方来源。"
SCRAPE_TARGET_GROUPS = ["待定"]
SCRAPE_KEY_CHANGES = ["待官方确认"]

# --- fixed values: text templates of city fee guides --------------------------------
CITY_GUIDE = {
    "service_key": "municipal_hundesteuer_{key}",
    "slug_title": "hundesteuer-{name}",
    "title_de": "Hundesteuer {name} — Anmeldung, Gebühren & Pflichten",
    "title_zh": "{name}犬税指南 — 登记、费用与养犬义务",
    "summary_zh": "{name}的犬税（Hundesteuer）：首犬 {first}，额外犬只 {extra}。养犬须办理登记、缴纳年度税费，"
                  "并购买犬只责任险（Hundehaftpflichtversicherung）。",
    "fees_zh": "首犬：{first}\n额外犬只（第二只起）：{extra}\n危险犬种可能有附加费，请向当地 Ordnungsamt 确认。",
    "duration_zh": "登记后按月/季/年持续缴纳，搬家至其他城市或犬只去世后须向市政厅申报注销",
    "publisher": "Stadt {name}",
    "source_name": "各市政厅 Hundesteuer 指南",
    "category": "生活行政",
    "region_level": "市",
}
CITY_GUIDE_REQUIREMENTS = [
    "有效身份证件或居留许可", "犬只芯片识别号 (Microchip)", "犬只责任险 (Hundehaftpflichtversicherung)",
    "在 {name} 的注册地址（Anmeldung）",
]
CITY_GUIDE_STEPS = [
    "在 {name} 市政厅或在线平台登记您的犬只", "市政厅核定犬税金额并发送缴费通知",
    "通过银行自动扣款（SEPA Lastschrift）按季度或年度缴纳税费", "购买犬只责任险（法律要求）",
    "搬家或犬只去世时，向市政厅申报变更或注销",
]
CITY_GUIDE_TAGS = ["犬税", "Hundesteuer", "{name}", "宠物登记", "养犬义务", "市政税务"]

# --- fixed values: text templates of office guides ----------------------------------
OFFICE_SUMMARY = (
    "{office}（LEA）{topic_name}相关指南。{office}负责居留许可、签证延期、入籍等事务的办理。"
    "本页面介绍了 {title} 的基本信息和办理方式。"
)
OFFICE_PERMIT_TAG = "居留许可"
KEYED_OFFICE = {
    "service_key": "hamburg_amt_fur_migration_{key}",
    "slug_title": "hamburg-amt-fur-migration-{key}",
    "title_de": "Hamburg Amt für Migration — {title}",
    "title_zh": "汉堡外管局 — {name}",
    "summary_zh": "汉堡移民局（Amt für Migration）{name}相关指南。{topic}事务由本部门负责办理。",
    "publisher": "Amt für Migration Hamburg",
    "source_name": "Hamburg Amt für Migration",
    "region_level": "市",
    "region_name": "Hamburg",
}
KEYED_OFFICE_TAGS = ["汉堡外管局", "Amt für Migration", "居留许可", "Hamburg", "{name}"]

# --- fixed values: text templates of scraped drafts and enrichment prompts ----------
SCRAPE_USER_NOTES = "来自 {origin} 抓取，标题需翻译审核"
PROMPT_BLOCKS = {
    "description": "===JOB {slot}===\nrefnr: {refnr}\n描述:\n{description}",
    "title": "===JOB {slot}===\nrefnr: {refnr}\n标题: {title}",
    "tags": "===JOB {slot}===\nrefnr: {refnr}\n职位: {title}\n描述: {description}",
    "guide": "===JOB {slot}===\nservice_key: {service_key}\nsource_name: {source_name}\nsource_url: {source_url}\n"
             "title_de: {title}\ncontent:\n{content}",
}

# --- fixed values: how each publisher's guide pages are read -------------------------
GUIDE_SOURCES = {
    "migration": {
        "prefix": "bamf", "root": ["#content"], "column": ".column", "tags": ["h2", "h3", "h4", "h5", "h6", "p", "li"],
        "skip_ancestors": [], "min_parts": 3, "title_within": ["#content"],
        "title_cut": r"^BAMF\s*-\s*Bundesamt[^\-]*-\s*", "title_default": "Untitled BAMF Page",
    },
    "foreign": {
        "prefix": "aa", "root": ["main"], "nav_max": 10, "min_length": 100, "title_within": ["sectionheader"], "title_last": True,
        "title_cut": r"\s*-\s*Federal Foreign Office\z", "title_default": "Untitled AA Page",
    },
    "consumer": {
        "prefix": "finanztip", "root": ["main"], "nav_max": 15, "min_length": 300, "title_within": ["main"],
        "title_default": "Untitled Finanztip Page",
    },
}

# --- fixed values: what sources say of themselves ------------------------------------
EXCHANGE_SOURCE = {
    "source_name": "DAAD（德国学术交流中心）", "publisher": "Deutscher Akademischer Austauschdienst (DAAD)",
    "region_level": "联邦", "region_name": "Deutschland", "category": "留学与大学",
}
EXCHANGE_TAGS = ["DAAD", "Studium in Deutschland", "internationale Studierende"]
OFFICE_SOURCE = {
    "city": "Berlin", "key_prefix": "berlin_lea", "slug_prefix": "berlin-lea", "title_prefix": "Berlin LEA — ",
    "title_prefix_zh": "柏林外管局 — ", "default_title": "Berlin LEA", "office_zh": "柏林外管局", "category": "居留与签证",
    "region_level": "市", "publisher": "Landesamt für Einwanderung Berlin", "source_name": "Berlin LEA (Landesamt für Einwanderung)",
}
