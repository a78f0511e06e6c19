"""Word lists, patterns and tables that must be as they are for equal results.

Patterns are in Java's dialect. Letters and digits of any script are written [\\p{L}\\p{N}_] and \\p{Nd}, since \\w and \\d are
ASCII only there.
"""

# fmt: off
TOKEN = r"[\p{L}\p{N}_؀-ۿ]+"
ARABIC = r"[؀-ۿ]"

# Words that aren't keywords of a question.
QUESTION_STOPWORDS_EN = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "of", "in", "on", "at", "to", "for", "and", "or", "what", "which", "who",
    "how", "why", "does", "do", "did", "this", "that", "these", "those", "it", "its", "with", "from", "about", "explain", "page", "chapter", "section",
)
QUESTION_STOPWORDS_AR = (
    "من", "في", "على", "إلى", "الى", "عن", "ما", "هل", "هذا", "هذه", "ذلك", "كيف", "لماذا", "ماذا", "و", "أو", "او", "صفحة", "الفصل", "قسم",
)

# What a question names.
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
PAGE_REFERENCE = r"(?iu)(?:page|صفحة|ص)\s*\.?\s*(\p{Nd}+)"
CHAPTER_HINT = r"(?iu)(chapter\s+\p{Nd}+|chapter\s+[ivxlcdm]+|الفصل\s+\S+)"
QUOTED = "[\"“]([^\"”]{2,80})[\"”]"
SECTION_HINT = r"(?iu)(?:section|قسم|الجزء)\s+(?:on|about|called|named|عن|بعنوان)?\s*[:\-]?\s*([A-Za-z؀-ۿ][\p{L}\p{N}_ ؀-ۿ]{1,60})"
YEAR = r"\b(1[5-9]\p{Nd}{2}|20\p{Nd}{2})\b"
TECHNOLOGIES = (
    "flutter", "react", "python", "java", "javascript", "typescript", "swift", "kotlin", "cnn", "rnn", "lstm", "transformer", "bert", "gpt",
    "tensorflow", "pytorch", "sql", "nosql", "docker", "kubernetes", "rest api", "graphql", "html", "css", "widget", "statefulwidget", "statelesswidget",
)
FORMULA = r"(?iu)\b(equation|formula|eq\.?)\s*(\p{Nd}+)\b"

# Intents, the first that matches.
INTENTS = (
    ("page_request", r"(?iu)\b(page|صفحة|ص)\s*\.?\s*\p{Nd}+\b"),
    ("citation_request", r"(?iu)\b(cite|citation|source for|where does .+ come from|ما هو مصدر|استشهاد)\b"),
    ("comparison", r"(?iu)\b(compare|comparison|vs\.?|versus|difference between|قارن|الفرق بين)\b"),
    ("timeline", r"(?iu)\b(timeline|chronology|order of events|in what order|history of|الجدول الزمني|بالترتيب الزمني)\b"),
    ("translation", r"(?iu)\b(translate|in (arabic|english)\??$|ترجم|بالعربي|بالانجليزي)\b"),
    ("formula_extraction", r"(?iu)\b(equation|formula|the formula for|معادلة|الصيغة)\b"),
    ("code_explanation", r"(?iu)\b(this code|the code (snippet|block)|what does this function do|هذا الكود|الكود التالي)\b"),
    ("exam_preparation", r"(?iu)\b(exam prep\w*|prepare for (the )?(exam|test)|quiz me|test me|تحضير للامتحان)\b"),
    ("study_notes", r"(?iu)\b(study notes?|notes for|ملخص للمذاكرة|ملاحظات دراسية)\b"),
    ("summary", r"(?iu)\b(summar(y|ize|ise)|tl;?dr|overview of|لخص|ملخص|اعطني ملخص)\b"),
    ("definition", r"(?iu)\b(what is|what are|define|definition of|meaning of|ما هو|ما هي|عرّف|تعريف)\b"),
    ("list", r"(?iu)\b(list|enumerate|what are the (types|kinds|steps|examples)|عدد|اذكر)\b"),
    ("explanation", r"(?iu)\b(explain|why (?:is|does|do|did)|how does|how do|elaborate|walk me through|teach me|help me understand|اشرح|فسّر|فسر|وضّح|وضح|لماذا|كيف يعمل|كيف تعمل|علّمني)\b"),
    ("finding_information", r"(?iu)\b(find|locate|where (is|does|can i find)|أين|وين)\b"),
)
DEFAULT_INTENT = "question_answering"
COMPLEXITIES = (
    ("beginner", r"(?iu)\b(simply|simple terms|like i'?m (five|new)|beginner|eli5|ببساطة|بشكل بسيط|كأني مبتدئ)\b"),
    ("advanced", r"(?iu)\b(in depth|advanced|technical detail|rigorous(ly)?|بعمق|بشكل متقدم|تقني)\b"),
)
DEFAULT_COMPLEXITY = "intermediate"

# Search plans by intent.
STRATEGIES = {
    "definition": "semantic_priority", "explanation": "semantic_priority", "formula_extraction": "keyword_priority", "citation_request": "keyword_priority",
    "code_explanation": "keyword_priority", "page_request": "filter_only", "comparison": "multi_target",
}
DEFAULT_STRATEGY = "hybrid_balanced"
DEEP_INTENTS = ("explanation", "summary", "comparison", "study_notes", "exam_preparation", "timeline", "code_explanation")
WIDTHS = {"filter_only": 0.5, "multi_target": 1.5}

# Answer styles, the first that matches.
STYLES = (
    ("comparison", r"(?iu)\b(compare|comparison|vs\.?|versus|difference between|قارن|الفرق بين)\b"),
    ("study_notes", r"(?iu)\b(study notes?|notes for|ملخص للمذاكرة|ملاحظات دراسية)\b"),
    ("exam_prep", r"(?iu)\b(exam prep\w*|prepare for (the )?(exam|test)|quiz me|test me|likely (exam )?questions?|تحضير للامتحان|اسئلة امتحان)\b"),
    ("teaching", r"(?iu)\b(teach me|as if teaching|like a teacher|tutor me|علمني|كأنك معلم|بأسلوب تعليمي)\b"),
    ("academic", r"(?iu)\b(academic(ally)?|formal (tone|register|explanation)|scholarly|رسمي|أكاديمي|اكاديمي)\b"),
    ("bullet_points", r"(?iu)\b(bullet\s*points?|as a list|in points|نقاط|في نقاط)\b"),
    ("detailed", r"(?iu)\b(in detail|detailed|thoroughly|comprehensive|بالتفصيل|بشكل مفصل)\b"),
)
DEFAULT_STYLE = "simple"
LONG_STYLES = ("detailed", "academic", "teaching", "study_notes")

# Length of the answer.
EXPLAIN = r"(?iu)\b(explain|why (?:is|does|do|did)|how does|how do|what'?s the difference|elaborate|walk me through|teach me|what does .+ mean|help me understand|what is the (?:purpose|significance|point) of|اشرح|فسّر|فسر|وضّح|وضح|لماذا|ليش|كيف يعمل|كيف تعمل|ما الفرق|ما هو الفرق|علّمني|علمني|ساعدني (?:على )?أفهم|ما المقصود|ايش يعني|ماذا يعني)\b"
LENGTH_SIGNALS = (
    ("short", r"(?iu)\b(briefly|brief|quick(?:ly)?|in short|one sentence|short answer|tl;?dr|باختصار|بإيجاز|بايجاز|بشكل مختصر|بشكل موجز|جملة واحدة|إجابة قصيرة|اجابة قصيرة|اختصر)\b"),
    ("long", r"(?iu)\b(in detail|detailed|thoroughly|comprehensive|in depth|elaborate|explain fully|بالتفصيل|بتفصيل|بشكل مفصل|بشكل مفصّل|بعمق|باستفاضة|اشرح بالكامل|بكل التفاصيل)\b"),
    ("short", r"(?iu)\b(shorter|make (?:it|that) shorter|too long|less detail|less verbose|condense|trim (?:it|that) down|cut (?:it|that) down|tldr this|اجعلها اقصر|اجعلها أقصر|اختصرها|طويلة جدا|طويلة جدًا|قلل التفاصيل|لخصها اكثر)\b"),
    ("long", r"(?iu)\b(more detail|go deeper|dig deeper|expand on (?:that|this)|elaborate more|say more|longer answer|more thorough|اعطني تفاصيل اكثر|أعطني تفاصيل أكثر|وسّع|وسع|فصّل اكثر|فصل أكثر|اشرح اكثر|اشرح أكثر)\b"),
)
SIMPLE_FACT = r"(?iu)^(is|are|does|do|did|can|could|will|would|was|were|has|have|who|when|where|how many|how much|what year|what date|هل|متى|أين|وين|كم|من هو|من هي|ما هو|ما هي|أي)\b"
OUTLINE_REQUEST = r"(?iu)\b(outline|table of contents|toc|list (the )?headings|structure of|فهرس|محتويات|هيكل)\b"

# Scopes of a question.
MULTI_CHAPTER = r"(?iu)chapters?\s*(\p{Nd}+)\s*(?:and|vs\.?|versus|,)\s*(?:chapter\s*)?(\p{Nd}+)|(?:الفصل|فصل)\s*(\p{Nd}+)\s*(?:و|مقابل)\s*(?:الفصل|فصل)?\s*(\p{Nd}+)"
PAGE_RANGE = r"(?iu)(?:pages?|صفحات|الصفحات)\s*(\p{Nd}+)\s*(?:-|to|through|–|الى|إلى)\s*(\p{Nd}+)"
CHAPTER = r"(?iu)\b(?:ch(?:apter)?\.?|الفصل|فصل)\s*(\p{Nd}+)\b"
ARABIC_ORDINALS = {"الأول": 1, "الاول": 1, "الثاني": 2, "الثالث": 3, "الرابع": 4, "الخامس": 5, "السادس": 6, "السابع": 7, "الثامن": 8, "التاسع": 9, "العاشر": 10}
WHOLE_DOCUMENT = r"(?iu)\b(the (whole|entire) document|this (book|document)|the (whole|entire) book|summarize (it|this) all|كل المستند|كل الكتاب|المستند بالكامل|الكتاب بالكامل|هذا الكتاب)\b"
QUOTED_SECTION = "(?iu)(?:section|قسم|الجزء)\\s+(?:on|about|called|named|عن|بعنوان)?\\s*[:\\-]?\\s*[\"“]([^\"”]{2,80})[\"”]"
SINGLE_PAGE = r"(?iu)\b(?:page|صفحة|الصفحة)\s*(\p{Nd}+)\b"
IMPLIED_SCOPE = r"(?iu)\b(this chapter|the chapter|this section|the section|study notes for|exam (prep|questions) for|هذا الفصل|الفصل هذا|هذا القسم)\b"

# Claims.
CITATION = r"(?i)\[p\.\s*([^\]]+)\]"
SENTENCE_END = ".!?؟"
PERCENT = r"\p{Nd}+(?:\.\p{Nd}+)?\s*%"
MONEY = r"(?iu)[$€£]\s?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?|\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?\s?(?:usd|eur|gbp)"
CLAIM_YEAR = r"\b(?:1[5-9]|20)\p{Nd}{2}\b"
DECIMAL = r"\b\p{Nd}+\.\p{Nd}+\b"
VERSION = r"(?iu)\bv?\p{Nd}+(?:\.\p{Nd}+){1,3}\b"
PLAIN_NUMBER = r"\b\p{Nd}{2,}\b"
GROUPED_NUMBER = r"\b\p{Nd}{1,3}(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?\b"
HEDGES = ("approximately", "about", "around", "roughly", "nearly", "circa", "~", "or so", "up to", "at least", "at most", "over", "under", "تقريبا", "حوالي", "نحو")
NEGATIONS = (
    "not", "no", "never", "cannot", "can't", "cant", "doesn't", "doesnt", "don't", "dont", "isn't", "isnt", "aren't", "arent", "wasn't", "wasnt",
    "weren't", "werent", "won't", "wont", "without", "unable", "fails to", "no longer", "none", "لا", "لم", "ليس", "غير", "بدون", "لن",
)
CLAIM_STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "as", "of", "in", "on",
    "to", "for", "and", "or", "but", "with", "from", "by", "at", "not", "no", "do", "does", "did", "has", "have", "had", "can", "will",
    "would", "should", "could", "may", "might", "also", "than", "then", "into", "about", "over", "under", "such", "which", "who", "what",
)
CONVERSATIONAL = r"(?iu)^(i couldn'?t find|i could not find|let me know|feel free|would you like|is there anything|does that|hope this helps|لم أجد|هل تريد|يسعدني)"
LIST_HEAD = r"(?iu)\b(uses|includes|supports|consists of|comprises|contains|offers|provides|has)\b\s+"
LIST_SPLIT = r"(?iu),\s*(?:and\s+)?|\s+and\s+"
MAJOR_CLAIM = r"(?iu)\b(?:guarantee[sd]?|always|never|completely|totally|fully|entirely|impossible|certain(?:ly)?|definitely|absolutely|no\s+risk|risk[- ]free|perfectly|zero\s+(?:downtime|risk|errors?))\b|100\s?%"
MAJOR_WEIGHT, MINOR_WEIGHT = 2.0, 1.0
KINDS = (
    ("definition", (" is defined as", " refers to", " means that", "is a term for"), None),
    ("causal", (" because ", " due to ", " as a result", " causes ", " leads to "), None),
    ("comparison", (" more than", " less than", " compared to", " whereas", " versus", " vs "), r"\b[\p{L}\p{N}_]+er\s+than\b"),
    ("conclusion", ("therefore", "in conclusion", "overall,", "in summary"), None),
    ("table", ("table", "figure"), None),
    ("formula", ("=", "∑", "∫", "√"), None),
)
AGGREGATION_CUES = ("total", "combined", "altogether", "in all", "sum", "overall")
METRICS = ("precision", "recall", "accuracy", "f1", "f1-score", "latency", "throughput", "error rate", "loss", "perplexity", "bleu", "rouge", "auc", "mae", "rmse")
NOT_FOUND_EN, NOT_FOUND_AR = "I couldn't find that in this document.", "لم أجد ذلك في هذا المستند."

# Weight in a layout: a span's flag, and names of fonts.
BOLD_FLAG = 16
BOLD_FONTS = ("bold", "black", "heavy")

# Marks of pages as they are shown: adjacent ones are one reference.
PAGE_MARKS = r"(?:\[p\.\s*[0-9٠-٩]+\])+"
PAGE_MARK = r"\[p\.\s*([0-9٠-٩]+)\]"
SHOWN_MARK = r"\[p\.\s?[\p{Nd},\-\s]+\]"

# Letters that count pages.
ABJAD = ("أ", "ب", "ج", "د", "ه", "و", "ز", "ح", "ط", "ي", "ك", "ل", "م", "ن", "س", "ع", "ف", "ص", "ق", "ر", "ش", "ت", "ث", "خ", "ذ", "ض", "ظ", "غ")

# Reranking.
NUMBER_WEIGHT, KEYWORD_WEIGHT, PAGE_WEIGHT, HEADING_WEIGHT = 0.35, 0.35, 0.15, 0.15
# fmt: on
