"""Fixed values of the message-risk domain.

Everything in this module is data that results depend on: word lists, labels,
thresholds, regular expressions and display texts.  No logic lives here.
"""

# --- Fixed values: columns and labels ---------------------------------------

TEXT_ALIASES = ["text", "sms", "message", "body", "email", "content", "msg"]
LABEL_ALIASES = ["label", "category", "target", "class", "type", "v1", "Tag"]

LEGITIMATE = "legitimate"
SUSPICIOUS = "suspicious"
FRAUDULENT = "fraudulent"
BINARY_LABELS = [LEGITIMATE, FRAUDULENT]

RAW_LABELS = {
    LEGITIMATE: [
        "ham", "legitimate", "safe", "normal", "ok", "benign", "not spam", "not_spam",
    ],
    FRAUDULENT: [
        "spam", "smishing", "phishing", "fraud", "scam", "malicious", "phish",
        "fraudulent", "smish",
    ],
    SUSPICIOUS: ["suspicious", "warning", "unknown"],
}

# --- Fixed values: word lists (matched as substrings of lower-cased text) ----

URGENCY_WORDS = [
    "urgente", "urgency", "urgent", "inmediatamente", "immediately",
    "ahora mismo", "right now", "ahora", "now", "rápido", "quickly",
    "expira", "expires", "vence", "deadline", "límite", "ultimo", "último",
    "final", "suspendido", "suspended", "bloqueado", "blocked",
    "cancelado", "cancelled", "verificar", "verify", "confirmar", "confirm",
    "actualizar", "update", "acceso restringido", "restricted access",
    "inmediato", "immediate",
]
MONEY_WORDS = [
    "dinero", "money", "pesos", "dólares", "dollars", "euros",
    "transferencia", "transfer", "depósito", "deposit", "pago", "payment",
    "cobro", "charge", "cuenta", "account", "banco", "bank",
    "tarjeta", "card", "crédito", "credit", "débito", "debit",
    "premio", "prize", "reward", "recompensa", "ganó", "won",
    "gratis", "free", "oferta", "offer", "descuento", "discount",
    "remesa", "remittance", "efectivo", "cash",
]
CREDENTIAL_WORDS = [
    "contraseña", "password", "clave", "key", "pin", "otp", "nip",
    "código", "code", "token", "número secreto", "secret number",
    "usuario", "user", "username", "datos personales", "personal data",
    "información confidencial", "confidential", "credencial", "credential",
    "acceso", "access", "login", "sesión", "session",
    "verificación", "verification", "autenticación", "authentication",
]
PRIZE_WORDS = [
    "premio", "prize", "ganó", "won", "felicidades", "congratulations",
    "ganador", "winner", "seleccionado", "selected", "elegido", "chosen",
    "sorteo", "lottery", "rifa", "raffle", "regalo", "gift",
    "oferta exclusiva", "exclusive offer", "descuento especial",
    "promoción", "promotion", "gratis", "free", "obsequio",
    "beneficio", "benefit", "recompensa", "reward",
]
ACCOUNT_BLOCK_WORDS = [
    "bloqueado", "blocked", "suspendido", "suspended", "desactivado",
    "deactivated", "restringido", "restricted", "cerrado", "closed",
    "cancelado", "cancelled", "vencido", "expired", "limite", "limit",
    "inhabilitado", "disabled",
]
TRANSFER_WORDS = [
    "transferencia", "transfer", "transferir", "depositar", "deposit",
    "enviar dinero", "send money", "pagar", "pay", "cobro", "cargo",
    "reembolso", "refund", "reintegro", "abono", "remesa", "remittance",
    "giro", "wire", "pago inmediato",
]
PRESSURE_WORDS = [
    "última oportunidad", "last chance", "no ignore", "no ignores",
    "imprescindible", "obligatorio", "mandatory", "requerido", "required",
    "inmediatamente", "immediately", "de lo contrario", "otherwise",
    "si no actúa", "si no responde", "perderá su cuenta", "will lose",
    "multa", "fine", "sanción", "penalty", "será eliminado", "will be deleted",
    "acción requerida", "action required", "responda ahora", "reply now",
]
IMPERSONATION_WORDS = [
    "banco", "bank", "bbva", "santander", "banamex", "hsbc", "citibanamex",
    "scotiabank", "banorte", "imss", "sat", "hacienda", "gobierno",
    "government", "policía", "policia", "police", "fedex", "dhl", "amazon",
    "microsoft", "apple", "paypal", "soporte técnico", "technical support",
    "representante", "ejecutivo", "official", "oficial",
]
BANK_WORDS = [
    "bbva", "santander", "hsbc", "banamex", "citibanamex", "banorte",
    "scotiabank", "inbursa", "azteca", "sat", "imss", "cfe",
    "banco", "bank", "paypal", "mercadopago",
]
# Matched as whole tokens, not as substrings.
NEGATION_WORDS = [
    "no", "not", "never", "jamás", "nunca", "sin", "without",
    "ningún", "ninguna", "ninguno", "nada", "nadie",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "can't",
]
NEGATION_WINDOW = 5

# --- Fixed values: character classes and patterns (Java regex syntax) --------

# Unicode white space, digits and word characters, spelled out because the
# defaults of the Java engine are ASCII only.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# ASCII is looked up first: one comparison decides nearly every character.
S = f"[[^!-~]&&[{SPACE}]]"
NS = f"[!-~[^{SPACE}]]"
D = r"\p{Nd}"
WORD = r"a-zA-Z0-9_\p{L}\p{N}"

# A host with a known top-level domain can only start where a run of
# non-space characters starts, which keeps the search linear.
CLEAN_URL = (
    rf"(?iu)https?://{NS}+|www\.{NS}+|bit\.ly/{NS}+|tinyurl\.com/{NS}+|t\.co/{NS}+"
    rf"|(?<!{NS}){NS}+\.(?:com|net|org|mx|co|io)/{NS}*"
)
RULE_URL = (
    rf"(?iu)https?://{NS}+|www\.{NS}+|bit\.ly/{NS}+|t\.co/{NS}+"
    rf"|(?<!{NS}){NS}+\.(?:com|net|org|mx)/{NS}*"
)
ENTITY_URL = (
    rf"(?iu)(?:https?://|www\.){NS}+"
    rf"|(?:bit\.ly|tinyurl\.com|goo\.gl|t\.co|short\.link)/{NS}+"
)
FEATURE_URL = rf"(?iu)<URL>|https?://{NS}+|www\.{NS}+"
EVIDENCE_URL = r"https?://|www\.|bit\.ly|tinyurl"
PATH_URL = r"https?://|www\."
PROFILE_URL = r"(?i)https?://|www\."

# \G allows a match right after the previous one, inside the same run.
EMAIL = r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"

RULE_PHONE = (
    rf"(?=[+(\p{{Nd}}])(\+?{D}{{1,3}}[{SPACE}\-.]?)?(\(?{D}{{2,4}}\)?[{SPACE}\-.]?)?"
    rf"{D}{{3,4}}[{SPACE}\-.]?{D}{{3,4}}"
)
CLEAN_PHONE = RULE_PHONE + rf"(?:[{SPACE}\-.]?{D}{{0,4}})?"
ENTITY_PHONE = rf"(?<!{D})(?:\+?52[{SPACE}\-]?)?(?:{D}[{SPACE}\-]?){{7,14}}(?!{D})"
FEATURE_PHONE = rf"<PHONE>|(?<![{WORD}]){D}{{7,}}(?![{WORD}])"
PHONE_MIN_DIGITS = 7

AMOUNT_UNIT = r"pesos?|dólares?|dollars?|euros?"
CLEAN_MONEY = (
    rf"(?iu)(?:\$|€|£|¥|USD|EUR|MXN|COP|ARS|BRL){S}*[{D},.]+"
    rf"|(?:\G|(?<![{D},.]))[{D},.]++{S}*+(?:\$|€|£|¥|USD|EUR|MXN)"
    rf"|(?<![{WORD}]){D}[{D},.]*+{S}*+(?:{AMOUNT_UNIT})(?![{WORD}])"
)
CLEAN_MONEY_MARKS = [
    "$", "€", "£", "¥", "usd", "eur", "mxn", "cop", "ars", "brl", "peso", "dólar", "dollar",
]
RULE_MONEY = (
    rf"(?iu)(?:\$|€|£|¥){S}*[{D},.]+"
    rf"|(?<![{D},.])[{D},.]++{S}*+(?:\$|€|£|¥)"
    rf"|(?<![{WORD}]){D}[{D},.]*+{S}*+(?:{AMOUNT_UNIT})(?![{WORD}])"
)
ENTITY_MONEY_MARKS = ["$", "€", "£", "mxn", "usd", "peso", "dólar", "dollar", "euro"]
RULE_MONEY_MARKS = ["$", "€", "£", "¥", "peso", "dólar", "dollar", "euro"]
ENTITY_AMOUNT = (
    rf"(?iu)(?:\$|€|£|MXN|USD){S}?{D}[{D},.]*"
    rf"|(?<!{D}){D}[{D},.]*+{S}?(?:{AMOUNT_UNIT})(?![{WORD}])"
)
FEATURE_MONEY = (
    rf"(?iu)<MONEY>|\$|€|£"
    rf"|(?<![{WORD}]){D}[{D},.]*+{S}*+(?:pesos?|dólares?|dollars?)(?![{WORD}])"
)
EVIDENCE_AMOUNT = (
    rf"(?iu)(?:\$|€|£|mxn|usd){S}?{D}"
    rf"|{D}[,.]*+{S}?(?:pesos?|dólares?|dollars?)"
)
PATH_NUMBER = rf"(?<![{WORD}]){D}{{7,}}(?![{WORD}])"

ENTITY_ACCOUNT = rf"(?<![{WORD}]){D}{{10,18}}(?![{WORD}])"
ENTITY_BANK = (
    rf"(?iu)(?<![{WORD}])(?:BBVA|Santander|HSBC|Citibanamex|Banamex|Banorte|Scotiabank|"
    rf"Inbursa|Azteca|Walmart|Oxxo|Coppel|SAT|IMSS|CFE|Telmex|"
    rf"PayPal|MercadoPago|Clip|Nu|Hey{S}?Banco|"
    rf"Chase|Wells{S}?Fargo|Bank{S}?of{S}?America|Citi|Barclays)(?![{WORD}])"
)
IRRELEVANT_CHARS = rf"[^{WORD}{SPACE}!?.,<>@#$%&*+\-/]"
# Irrelevant characters and white space between relevant ones, but for a single blank.
GAP = rf" [^{WORD}!?.,<>@#$%&*+\-/]++|[^ {WORD}!?.,<>@#$%&*+\-/][^{WORD}!?.,<>@#$%&*+\-/]*+"
RELEVANT_CHAR = rf"[{WORD}!?.,<>@#$%&*+\-/]"
TERM = rf"[{WORD}]{{2,}}"

URL_TOKEN, EMAIL_TOKEN, PHONE_TOKEN, MONEY_TOKEN = "<URL>", "<EMAIL>", "<PHONE>", "<MONEY>"

# --- Fixed values: rule points, signal texts and levels ----------------------

SIGNAL_POINTS = {
    "url": 20, "phone": 10, "email": 10, "money": 15, "urgency": 20, "block": 20,
    "prize": 15, "transfer": 20, "credential": 25, "pressure": 20,
    "money_words": 10, "exclamation": 5,
}
SIGNAL_TEXT = {
    "url": "Contiene URL",
    "phone": "Contiene número de teléfono",
    "email": "Contiene dirección de correo electrónico",
    "money": "Menciona cantidades monetarias",
    "urgency": "Usa lenguaje de urgencia",
    "block": "Amenaza con bloqueo o suspensión de cuenta",
    "prize": "Menciona premios, regalos u ofertas",
    "transfer": "Solicita transferencia o pago",
    "credential": "Solicita contraseña, código, PIN u OTP",
    "pressure": "Usa lenguaje de presión o amenaza",
    "money_words": "Menciona términos financieros o bancarios",
    "exclamation": "Uso excesivo de signos de exclamación",
}
EXCLAMATION_MIN = 3
SCORE_CAP = 100
SCORE_MEDIUM, SCORE_HIGH = 30, 60

LEVELS = ["low", "medium", "high"]
RECOMMENDATION = {
    "low": "No se detectan señales fuertes de fraude.",
    "medium": "El mensaje contiene señales sospechosas. Verifique la fuente antes de responder.",
    "high": "Posible fraude. No comparta datos personales, códigos ni realice pagos.",
}
RECOMMENDATION_DEFAULT = "Verifique el mensaje con precaución."
FRAUD_TYPE_SUFFIX = {
    "phishing": " Posible intento de phishing.",
    "smishing": " Es un posible SMS de smishing.",
    "prize_scam": " Oferta de premio falso — no responda.",
    "urgency_scam": " Usa urgencia artificial para presionarle.",
    "credential_theft": " Busca robar credenciales o códigos de verificación.",
    "financial_scam": " Intenta obtener dinero o datos bancarios.",
    "spam": " Mensaje de spam no solicitado.",
}

# --- Fixed values: features and scorers --------------------------------------

MANUAL_FEATURES = [
    "msg_length", "word_count", "exclamation_count", "question_count",
    "has_url", "has_phone", "has_email", "has_money",
    "uppercase_word_count", "has_urgency", "has_money_words",
    "has_credential_words", "has_prize_words",
    "negation_score", "entity_count", "has_phone_ner", "has_amount_ner",
]
TFIDF_MAX_FEATURES, TFIDF_NGRAMS, TFIDF_MIN_DF = 10_000, (1, 3), 2
PARTS_PER_FEATURE = 4   # shorter terms kept for every feature while the longest are counted
ANOMALY_MAX_FEATURES, ANOMALY_NGRAMS = 3_000, (1, 2)
ANOMALY_TREES, ANOMALY_SAMPLE, ANOMALY_CONTAMINATION = 200, 256, 0.05
ANOMALY_MIN_ROWS = 10
TEST_SIZE, SEED = 0.2, 42
EVIDENCE = [
    "url_present", "urgency", "credential_request",
    "bank_mentioned", "amount_present", "negation_present",
]
NEIGHBOUR_CASES = 7
INDEX_PER_CLASS, INDEX_NEIGHBOURS, INDEX_MESSAGE_CHARS = 500, 5, 200
META_FEATURES = [
    "ml_proba_fraud", "rule_score_norm", "emb_fraud_sim", "emb_legit_sim",
    "anomaly_score", "transformer_proba", "bayes_score", "cbr_score",
]
META_SAMPLE = 2000
PSEUDO_CONFIDENCE = 0.90

CASCADE_DEFAULTS = {
    "ml_conf_certain": 0.95, "rule_fraud_min": 65, "rule_legit_max": 15,
    "emb_fraud_confirm": 0.88, "emb_legit_confirm": 0.88, "emb_fraud_threat": 0.80,
    "emb_boost_high": 0.85, "emb_boost_medium": 0.70,
    "anomaly_boost_thr": 0.75, "transformer_high": 0.70, "transformer_med": 0.50,
    "bayes_high_thr": 0.85, "cbr_high_thr": 0.86,
    "meta_high_thr": 0.70, "meta_med_thr": 0.35,
}
SWEEP_BOUNDS = {
    "ml_conf_certain": (0.70, 0.99), "emb_fraud_confirm": (0.60, 0.99),
    "anomaly_boost_thr": (0.50, 0.99), "bayes_high_thr": (0.50, 0.99),
    "meta_high_thr": (0.40, 0.90),
}
LEAF_ROWS = 20          # least rows of a leaf of boosted trees
TRAINING_ROWS = 20_000  # rows that are worth a partition of their own in training
BOOSTING_BOUNDS = {
    "maxIter": (50, 500), "maxDepth": (2, 10),
    "stepSize": (0.01, 0.30), "minInstancesPerNode": (5, 80),
}

# --- Fixed values: conversations ---------------------------------------------

WINDOW_SIZES = [2, 3, 5, 8]
WINDOW_FEATURES = [
    "risk_slope", "risk_delta", "risk_max", "risk_mean", "risk_variance",
    "risk_acceleration", "late_risk_spike", "early_risk_mean", "late_risk_mean",
    "ml_fraud_ratio", "ml_fraud_late_ratio", "ml_legit_early_ratio",
    "signal_total", "signal_slope", "signal_last",
    "urgency_count", "credential_count", "impersonation_count",
    "prize_count", "pressure_count", "transfer_count",
    "urgency_late_ratio", "credential_late_ratio", "prize_early_ratio",
    "n_messages",
]
CONVERSATION_DEFAULTS = {
    "candidate_threshold": 0.40, "overlap_ratio": 0.60,
    "pattern_weight": 0.55, "model_weight": 0.45,
    "critical_threshold": 0.80, "high_threshold": 0.60, "medium_threshold": 0.35,
}
PATTERN_CAP = 0.92
# name: (smallest window, description)
PATTERNS = {
    "urgency_escalation": (
        3, "La urgencia aumenta progresivamente a lo largo de los mensajes"),
    "credential_harvesting": (
        2, "Solicitud escalonada de credenciales, códigos o datos personales"),
    "social_engineering": (
        4, "Mensajes iniciales inofensivos que derivan en solicitud fraudulenta"),
    "impersonation": (
        2, "Suplantación de entidad oficial (banco, gobierno, empresa) + acción requerida"),
    "prize_scam_sequence": (
        2, "Anuncio de premio seguido de solicitud de datos o pago para reclamarlo"),
    "financial_coercion": (
        2, "Presión o amenaza combinada con solicitud de transferencia o pago"),
    "trust_building_attack": (
        4, "Conversación aparentemente inofensiva que culmina en solicitud fraudulenta"),
}
ENCODED_MESSAGES, ENCODED_TEXT_CHARS = 10, 300
SNIPPET_CHARS, REPORT_TEXT_CHARS = 50, 80
PATH_LENGTH = 4
PATH_LEVELS = [(0.7, "ESCALADA SEVERA"), (0.4, "ESCALADA MODERADA"), (0.0, "PATRÓN LEVE")]
SEQUENCE_SHARES = {
    "all_legit": 0.25, "all_fraud": 0.25, "trust_attack": 0.35, "escalation": 0.15,
}

# --- Fixed values: variants of messages --------------------------------------

FILLER_WORDS = [
    "bien", "favor", "así", "solo", "más", "muy", "también",
    "siempre", "ahí", "aquí", "esto", "eso", "todo", "nada",
]
GREETINGS = [
    "Hola, espero que estés bien. ",
    "Buenos días. ",
    "Estimado cliente, ",
    "Como siempre, con mucho gusto le atendemos. ",
    "Un cordial saludo. ",
]
CLOSINGS = [
    " Que tenga un buen día.",
    " Saludos cordiales.",
    " Quedamos a sus órdenes.",
    " Gracias por su preferencia.",
]
URGENCY_SYNONYMS = {
    "urgente": ["importante", "prioritario", "crítico"],
    "urgent": ["important", "critical", "essential"],
    "inmediatamente": ["pronto", "en breve", "lo antes posible"],
    "immediately": ["soon", "promptly", "right away"],
    "ahora": ["en este momento", "actualmente", "hoy"],
    "now": ["at this time", "today", "currently"],
    "rápido": ["breve", "rápidamente", "sin tardanza"],
    "quickly": ["promptly", "briefly"],
    "suspendido": ["limitado", "restringido temporalmente"],
    "blocked": ["limited", "temporarily restricted"],
    "bloqueado": ["limitado", "en revisión"],
    "verify": ["review", "check", "confirm once"],
    "verificar": ["revisar", "consultar", "confirmar"],
}
NEGATION_PREFIXES = [
    "No te preocupes, pero ",
    "Aunque no es urgente, ",
    "Sin presiones, ",
    "Cuando puedas, ",
]
LOOKALIKES = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "$"}
STABILITY_TEXT = {
    "fraud": "PREDICCIÓN MUY ESTABLE — fraude confirmado con alta confianza",
    "legit": "PREDICCIÓN MUY ESTABLE — mensaje legítimo con alta confianza",
    "stable": "PREDICCIÓN ESTABLE — resultado consistente ante variaciones",
    "moderate": "PREDICCIÓN MODERADA — algunos cambios alteran el veredicto",
    "unstable": "PREDICCIÓN INESTABLE — resultado sensible al texto exacto",
}
COMMON_WORDS = [
    "de", "la", "el", "en", "a", "y", "que", "se", "su", "un",
    "una", "los", "las", "es", "por", "con", "para", "al", "del",
]
