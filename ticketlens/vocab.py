"""Vocabularies, rule patterns and output sentences.

Everything in the "FIXED VALUES" block must equal the triage policy we
reproduce, value for value, or results differ; it is stated plainly and in
natural order.  Everything after it (ticket templates, record status names)
is our own fixture wording.
"""
from __future__ import annotations


# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced policy)
# ---------------------------------------------------------------------------

QUERY_TYPES = ("payment", "delivery", "refund", "account_access", "technical_support", "other")

INTENT_TO_QUERY_TYPE = {
    "payment_issue": "payment",
    "duplicate_charge": "payment",
    "payment_failed": "payment",
    "payment_methods": "payment",
    "delivery_options": "delivery",
    "delivery_delay": "delivery",
    "track_order": "delivery",
    "delivery_address": "delivery",
    "missing_delivery": "delivery",
    "refund_policy": "refund",
    "refund_request": "refund",
    "refund_pending": "refund",
    "account_access": "account_access",
    "account_creation": "account_access",
    "account_management": "account_access",
    "technical_login_error": "technical_support",
    "technical_app_crash": "technical_support",
    "technical_checkout_error": "technical_support",
    "technical_website_error": "technical_support",
    "technical_device_setup": "technical_support",
    "technical_product_malfunction": "technical_support",
    "human_request": "other",
    "general_complaint": "other",
    "order_cancellation": "other",
    "order_change": "other",
    "cancellation_fee": "other",
    "invoice_request": "other",
    "product_information": "other",
    "newsletter": "other",
}

DEPARTMENTS = {
    "payment": "Payments Support",
    "delivery": "Logistics Support",
    "refund": "Returns & Refunds",
    "account_access": "Account Support",
    "technical_support": "Technical Support",
    "other": "General Support",
}
DEFAULT_DEPARTMENT = "General Support"
HUMAN_QUEUE = "Human Escalation Queue"

LOW_CONFIDENCE_THRESHOLD = 0.45

# Legacy broad label -> fine intent (training-set harmonisation).
LEGACY_LABEL_TO_INTENT = {
    "payment": "payment_issue",
    "delivery": "delivery_delay",
    "refund": "refund_request",
    "account_access": "account_access",
    "technical_support": "technical_website_error",
    "other": "general_complaint",
}

LANGUAGE_NAMES = {
    "en": "English", "as": "Assamese", "bn": "Bengali", "gu": "Gujarati",
    "hi": "Hindi", "kn": "Kannada", "ml": "Malayalam", "mr": "Marathi",
    "ne": "Nepali", "or": "Odia", "pa": "Punjabi", "ta": "Tamil",
    "te": "Telugu", "ur": "Urdu", "sa": "Sanskrit", "es": "Spanish",
    "fr": "French", "de": "German",
}
UNKNOWN_LANGUAGE = "Unknown language"

# Script ranges tried in order after Devanagari (0900-097F -> hi).
DEVANAGARI = (0x0900, 0x097F, "hi")
SCRIPT_RANGES = (
    (0x0980, 0x09FF, "bn"),
    (0x0A00, 0x0A7F, "pa"),
    (0x0A80, 0x0AFF, "gu"),
    (0x0B00, 0x0B7F, "or"),
    (0x0B80, 0x0BFF, "ta"),
    (0x0C00, 0x0C7F, "te"),
    (0x0C80, 0x0CFF, "kn"),
    (0x0D00, 0x0D7F, "ml"),
    (0x0600, 0x06FF, "ur"),
)

NEGATIVE_WORDS = ("angry", "bad", "broken", "disappointed", "failed", "hate", "late", "problem", "refund", "urgent", "wrong")
POSITIVE_WORDS = ("good", "great", "helpful", "love", "perfect", "thanks")
SENTIMENT_STEP = 0.2
LEXICON_SOURCE = "lexical fallback; install VADER lexicon for formal evaluation"

# Rule pattern groups, matched case-insensitively on normalised lower-case text.
CRITICAL_PATTERNS = (
    r"\bunauthori[sz]ed\b",
    r"\bfraud(?:ulent)?\b",
    r"\b(?:account (?:is )?compromised|compromised my account)\b",
    r"\b(?:stolen (?:account|identity|payment)|identity (?:was )?stolen)\b",
    r"\bsuspicious (?:charge|payment|activity)\b",
    r"\bsecurity breach\b",
    r"\b(?:do not|don't|cannot|can't) recognize (?:this |the )?(?:charge|transaction|payment)\b",
)
HIGH_PATTERNS = (
    r"\bcharged? (?:me )?twice\b",
    r"\bdouble (?:charge|charged)\b",
    r"\b(?:payment|checkout) (?:was )?(?:failed|declined)\b",
    r"\b(?:locked|lockout|locked out)\b",
    r"\b(?:urgent|urgently|emergency|immediately)\b",
    r"\b(?:not arrived|not delivered|still (?:hasn't|has not) arrived)\b",
    r"\b(?:delivered|delivery).{0,30}\b(?:missing|not here)\b",
)
HUMAN_PATTERNS = (
    r"\b(?:human|real person|live agent|representative|supervisor)\b",
    r"\btalk to (?:an? )?(?:agent|person|human)\b",
    r"\bspeak to (?:an? )?(?:agent|person|human)\b",
)
VAGUE_PATTERNS = (
    r"\bcannot explain\b",
    r"\bsomething confusing\b",
    r"\bnot sure (?:what|how)\b",
)
ROUTINE_INTENTS = ("payment_methods", "delivery_options", "delivery_address", "refund_policy", "product_information", "newsletter")
SPECIALIST_QUERY_TYPES = ("payment", "refund", "account_access", "technical_support")

# Entity extraction patterns (case-insensitive except amounts).
ORDER_ID_PATTERN = r"\b(?:order\s*(?:id|number)?\s*[:#-]?\s*)?((?!(?:TXN|REF|TRACK)-?)[A-Z]{2,6}-?\d{4,12})\b"
TRACKING_ID_PATTERN = r"\b(?:tracking|shipment|parcel)\s*(?:id|number)?\s*[:#-]?\s*([A-Z0-9-]{6,24})\b"
TRANSACTION_ID_PATTERN = r"\b(?:txn|transaction|reference)\s*(?:id|number)?\s*[:#-]?\s*([A-Z0-9-]{5,20})\b"
CARD_REF_PATTERN = r"\b(?:card\s*)?(?:ending|last\s*(?:four|4)|last\s*digits?)\s*(?:in\s*)?(\d{4})\b"
AMOUNT_PATTERN = r"(?:₹|\$|€|£)\s?\d+(?:[,.]\d{1,2})?"
DATE_PATTERN = r"\b(?:today|yesterday|tomorrow|\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?)\b"
ENTITY_FIELDS = ("order_ids", "tracking_ids", "transaction_ids", "card_references", "amounts", "dates")
MASKED_ENTITY_FIELDS = ("order_ids", "tracking_ids", "transaction_ids")

# PII masking rules, applied in this order.
EMAIL_PATTERN = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
ACCOUNT_PATTERN = r"\b(?:account\s*(?:number|no\.?|#)?\s*[:=-]?\s*)\d{6,18}\b"
LONG_NUMBER_PATTERN = r"(?<!\d)(?:\d[ -]?){11,18}\d(?!\d)"
PHONE_PATTERN = r"(?<!\w)(?:\+?\d{1,3}[ .-]?)?(?:\(?\d{2,4}\)?[ .-]?){2,4}\d{3,4}(?!\w)"
EMAIL_MARK = "[EMAIL]"
ACCOUNT_MARK = "account [REDACTED]"
LONG_NUMBER_MARK = "[SENSITIVE_NUMBER]"
PHONE_MARK = "[PHONE]"
REDACTED = "[REDACTED]"

# Output sentences.
EXPLAIN_SELECTED = "Fine-intent classifier selected '{intent}' with {pct} confidence."
REASON_CRITICAL = "Security or suspected-fraud indicator detected"
EXPLAIN_CRITICAL = "Critical risk language overrides the normal route."
EXPLAIN_HIGH = "High-impact issue or explicit urgency indicator detected."
EXPLAIN_SPECIALIST = "This complaint type requires timely specialist review."
EXPLAIN_NEGATIVE = "Negative sentiment raises review priority but does not decide it alone."
EXPLAIN_LOW = "No critical, high-impact, or negative-sentiment indicator was found."
REASON_LOW_CONF = "Low routing confidence (intent {pct})"
EXPLAIN_LOW_CONF = "A human should verify routing because the classifier is uncertain."
REASON_VAGUE = "Message lacks enough detail for safe automated routing"
EXPLAIN_VAGUE = "A human should clarify this vague request before taking action."
REASON_HUMAN = "Customer explicitly requested a human agent"
EXPLAIN_HUMAN = "The explicit request for a human agent is honored."
REASON_NOT_FOUND = "Operational reference not found in company records"
EXPLAIN_NOT_FOUND = "A supplied operational reference was not found, so an agent must verify it safely."
REASON_LANGUAGE = "{language} message requires a configured translation model"
EXPLAIN_LANGUAGE = "The deployed classifier is English-first, so a human must review untranslated text."

VERIFY_NONE = ("no_reference_provided", "No operational reference supplied",
               "No order, tracking, or transaction reference was available for a record lookup.", False)
VERIFY_MISSING = ("reference_not_found", "Reference not found — manual review required",
                  "At least one supplied reference was not found in the demonstration company records. The request must be checked by an agent.", True)
VERIFY_FOUND = ("record_found_ownership_required", "Record found — ownership check required",
                "A matching demonstration record was found. Customer ownership still requires secure account-side verification.", True)

DELIVERY_INTENTS_NEEDING_REF = ("delivery_delay", "missing_delivery", "track_order")
PAYMENT_INTENTS_NEEDING_REF = ("payment_issue", "duplicate_charge", "payment_failed", "refund_pending")
TECHNICAL_CONTEXT_WORDS = ("error", "code", "app", "website", "device", "browser")
ASK_DELIVERY_REF = "Please share your order ID or tracking ID so the support team can check the correct shipment."
ASK_PAYMENT_REF = "Please share a transaction ID or the last four digits of the payment card. Do not share a full card number, password, or OTP."
ASK_TECHNICAL = "Which app, website, device, or browser is affected, and what error message do you see?"

ANSWER_ESCALATED = ("Your ticket has been escalated to a human agent. They will securely verify the relevant account, "
                    "order, delivery, or payment details before taking action.")
ANSWER_NONE = "I could not find a supported policy answer for this request, so a human agent should review it."
ANSWER_PREFIX = "Based on the knowledge base: "
MIN_GROUNDED_SCORE = 0.10
RETRIEVAL_BACKEND = "TF-IDF fallback"

DUPLICATE_THRESHOLD = 0.62
DUPLICATE_LIMIT = 3
RETRIEVAL_K = 3

MIN_MESSAGE_CHARS = 3
MAX_MESSAGE_CHARS = 5000
# Least and most characters of the optional fields of an agent's update.
FIELD_LENGTHS = {"outcome": (0, 3000), "reviewer": (2, 80), "final_query_type": (0, 64), "final_intent": (0, 96), "reply": (0, 2000)}
MAX_ATTACHMENT_BYTES = 2 * 1024 * 1024
ATTACHMENT_EXTENSIONS = ("txt", "pdf", "docx")
TICKET_STATUSES = ("open", "in_progress", "resolved")
RECEIVED_STATUS = "received"
HUMAN_REVIEW_SOURCE = "human_review"
ORIGINAL_SOURCE = "original_training"
SPLIT_SEED = 42
TEST_FRACTION = 0.2
QUEUE_LIMIT_DEFAULT, QUEUE_LIMIT_MIN, QUEUE_LIMIT_MAX = 50, 1, 200
ECE_BINS = 10

# Customer-facing event message per status in the ticket event log.
STATUS_EVENT_MESSAGES = {
    "received": "Ticket received and routed to the appropriate support queue.",
    "resolved": "Resolved by the support team.",
    "in_progress": "Your ticket is now being reviewed by the support team.",
    "open": "Your ticket remains open with the assigned support team.",
}
DRAFT_PREFIX = "Hello, thank you for contacting support. "
FEEDBACK_EXPORT_FIELDS = ("ticket_id", "customer_message", "predicted_query_type", "predicted_intent", "final_query_type",
                          "final_intent", "reviewer", "notes", "status", "reviewed_at")

# Text tokens a pandas CSV reader treats as missing by default.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Whitespace as Python's str.isspace() sees it (code-point ranges).
WHITESPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)

# ---------------------------------------------------------------------------
# End of fixed values.  Our own fixture wording follows.
# ---------------------------------------------------------------------------

# Ticket templates for the rendered-tickets fixture: (intent, text).  Slots:
# {order} {tracking} {txn} {amount} {card} {phone} {email} {date}.
TICKET_TEMPLATES = (
    ("payment_issue", "I was billed {amount} for order {order} but my bank shows an error on transaction {txn}."),
    ("duplicate_charge", "You charged me twice for order {order} with the card ending {card}, please sort it out."),
    ("payment_failed", "My payment was declined at checkout yesterday for {amount}."),
    ("payment_methods", "Which payment methods do you accept, and can I pay with a gift voucher?"),
    ("delivery_options", "What delivery options exist for express shipping to my town?"),
    ("delivery_delay", "My parcel for order {order} is late and has not arrived after two weeks."),
    ("track_order", "Could you share an update on tracking number {tracking}? Thanks for the help."),
    ("delivery_address", "I need to change the delivery address on order {order} to my new flat."),
    ("missing_delivery", "The courier marked it delivered on {date} but the box is missing from my porch."),
    ("refund_policy", "What is the refund policy for opened items that cost {amount}?"),
    ("refund_request", "I want a refund for order {order}, the blender arrived broken and I am disappointed."),
    ("refund_pending", "My refund for transaction {txn} is still pending after ten days."),
    ("account_access", "I am locked out of my account after resetting the password."),
    ("account_creation", "How do I open a new account with the address {email} please?"),
    ("account_management", "Please update the contact number on my profile to {phone} today."),
    ("technical_login_error", "The sign-in page shows error code 502 every time I try to log on."),
    ("technical_app_crash", "It keeps freezing and then shuts down, no idea what to do now."),
    ("technical_checkout_error", "Checkout failed on the website with {amount} in my basket."),
    ("technical_website_error", "Your website will not load in my browser since this morning."),
    ("technical_device_setup", "I cannot pair the smart speaker with my device, setup never finishes."),
    ("technical_product_malfunction", "The kettle from order {order} stopped heating, this happened after one week."),
    ("human_request", "I want to speak to a human, not a bot, about order {order}."),
    ("general_complaint", "Your service is bad and the driver was rude, I hate this."),
    ("order_cancellation", "Please cancel order {order} before it ships out."),
    ("order_change", "Can I switch the size on order {order} to a medium one?"),
    ("cancellation_fee", "Why was I charged a cancellation fee of {amount} on {date}, card ending {card}?"),
    ("invoice_request", "Please send an invoice for order {order} to {email} thanks"),
    ("product_information", "Does the blue backpack come with a warranty? Great product, thanks"),
    ("newsletter", "Please remove {email} from the newsletter, I get far too many mails."),
    ("payment_issue", "There is an unauthorized charge of {amount} on my card ending {card}, I think it is fraud."),
    ("account_access", "My account is compromised, someone changed the password and the contact details."),
    ("payment_issue", "I don't recognize this transaction {txn} for {amount} from {date}."),
    ("general_complaint", "Something confusing happened with my order and I cannot explain it."),
    ("delivery_delay", "Hola, mi pedido {order} no ha llegado todavía, ayuda por favor."),
    ("delivery_delay", "मेरा ऑर्डर {order} अभी तक नहीं पहुंचा है, कृपया मदद करें।"),
    ("track_order", "Where is my package, what is the tracking number please?"),
    ("duplicate_charge", "Payment TXN-{digits} went through two times, I was double charged."),
    ("general_complaint", "URGENT: I need help immediately, the item in order {order} is wrong."),
    ("product_information", "thanks good great helpful love bad wrong late broken failed overall"),
    ("refund_request", "good great bad wrong late refund for order {order} please"),
)

# What a reader expects of each template's message, written by hand and not by the
# rules: priority, and whether the message itself needs a person.
EXPECTED_TRIAGE = (
    ("medium", False), ("high", False), ("high", False), ("low", False), ("low", False), ("high", False), ("low", False),
    ("low", False), ("high", False), ("low", False), ("medium", False), ("medium", False), ("high", False), ("low", False),
    ("low", False), ("medium", False), ("medium", False), ("high", False), ("medium", False), ("medium", False),
    ("medium", False), ("low", True), ("medium", False), ("low", False), ("low", False), ("low", False), ("low", False),
    ("low", False), ("low", False), ("critical", True), ("critical", True), ("critical", True), ("medium", True),
    ("high", True), ("high", True), ("low", False), ("high", False), ("high", False), ("low", False), ("medium", False),
)

# Status from the event type; everything else is open.
EVENT_STATUS = {"click": "in_progress", "purchase": "resolved"}
ORDER_STATUS_NAMES = {"F": "delivered", "O": "in_transit", "P": "processing"}
TRANSACTION_STATUS_NAMES = {"F": "settled", "O": "pending", "P": "authorised"}


# FIXED VALUES: the public 318-word English stop list that the reference's vectoriser uses.
STOP_WORDS = tuple((
    "a about above across after afterwards again against all almost alone along already also "
    "although always am among amongst amoungst amount an and another any anyhow anyone anything "
    "anyway anywhere are around as at back be became because become becomes becoming been before "
    "beforehand behind being below beside besides between beyond bill both bottom but by call can "
    "cannot cant co con could couldnt cry de describe detail do done down due during each eg "
    "eight either eleven else elsewhere empty enough etc even ever every everyone everything "
    "everywhere except few fifteen fifty fill find fire first five for former formerly forty "
    "found four from front full further get give go had has hasnt have he hence her here "
    "hereafter hereby herein hereupon hers herself him himself his how however hundred i ie if in "
    "inc indeed interest into is it its itself keep last latter latterly least less ltd made many "
    "may me meanwhile might mill mine more moreover most mostly move much must my myself name "
    "namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere "
    "of off often on once one only onto or other others otherwise our ours ourselves out over own "
    "part per perhaps please put rather re same see seem seemed seeming seems serious several she "
    "should show side since sincere six sixty so some somehow someone something sometime "
    "sometimes somewhere still such system take ten than that the their them themselves then "
    "thence there thereafter thereby therefore therein thereupon these they thick thin third this "
    "those though three through throughout thru thus to together too top toward towards twelve "
    "twenty two un under until up upon us very via was we well were what whatever when whence "
    "whenever where whereafter whereas whereby wherein whereupon wherever whether which while "
    "whither who whoever whole whom whose why will with within without would yet you your yours "
    "yourself yourselves "
).split())


def default_stop_words() -> tuple[str, ...]:
    """The English stop list; pass another one as a parameter where it is wanted."""
    return STOP_WORDS
