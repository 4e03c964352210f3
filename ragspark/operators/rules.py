"""Rule literals of the checks. Results depend on them as they stand."""

# Prompt injection patterns.
INJECTION = [
    r"ignore\s+previous\s+instructions",
    r"forget\s+everything",
    r"disregard\s+.+instructions",
    r"system\s*:",
    r"assistant\s*:",
    r"<\|.*?\|>",
    r"###\s*instruction",
    r"you\s+are\s+now",
    r"new\s+instructions",
    r"override\s+previous",
    r"ลืม.*คำสั่ง",
    r"เพิกเฉย.*คำสั่ง",
    r"ไม่สนใจ.*คำสั่ง",
    r"คำสั่งใหม่",
    r"ระบบ\s*:",
    r"ผู้ช่วย\s*:",
]

# Profanity patterns.
PROFANITY = [
    r"\b(damn|hell|shit|fuck|bitch)\b",
    r"\b(โง่|ชั่ว|แย่)\b",
]

# Toxicity patterns.
TOXICITY = [
    r"\b(kill|murder|die|death|hurt|harm|violence|attack)\b",
    r"\b(threat|threaten|revenge|destroy)\b",
    r"\b(suicide|self.harm|cut.myself|end.my.life)\b",
    r"\b(stupid|idiot|loser|worthless|pathetic)\b",
    r"\b(shut.up|go.away|leave.me.alone)\b",
    r"\b(ตาย|ฆ่า|ทำร้าย|ทำลาย)\b",
    r"\b(โง่|ปัญญาอ่อน|ไร้ค่า|น่าเกลียด)\b",
    r"\b(หุบปาก|ไปให้พ้น|เลิกมาเยอะ)\b",
]

# A toxicity pattern has the severity of the first group it shares a word with.
TOXICITY_LEVELS = [
    (1.0, ["kill", "murder", "suicide", "ตาย", "ฆ่า"]),
    (0.8, ["harm", "hurt", "ทำร้าย"]),
    (0.6, ["stupid", "idiot", "โง่"]),
]
TOXICITY_OTHER = 0.5

# Hate speech patterns.
HATE = [
    r"\b(hate|despise|disgust).*(race|ethnicity|religion|gender|sexual)\b",
    r"\b(inferior|superior).*(race|ethnicity|people|group)\b",
    r"\b(all|those).*(people|men|women).*(are|should).*(bad|evil|wrong)\b",
    r"\b(เกลียด|รังเกียจ).*(เชื้อชาติ|ศาสนา|เพศ)\b",
    r"\b(ด้อยกว่า|เหนือกว่า).*(คน|กลุ่ม|เชื้อชาติ)\b",
]

# Protected characteristics.
PROTECTED = [
    "race",
    "ethnicity",
    "religion",
    "gender",
    "sexual orientation",
    "disability",
    "age",
    "nationality",
    "เชื้อชาติ",
    "ศาสนา",
    "เพศ",
    "อายุ",
    "สัญชาติ",
]

# Phrases of an answer that declines.
DECLINING = [
    "i don't know",
    "i cannot answer",
    "i'm not sure",
    "ไม่ทราบ",
    "ไม่แน่ใจ",
    "ตอบไม่ได้",
    "ไม่สามารถตอบได้",
]

# Phrases of uncertainty.
UNCERTAIN = [
    "i think",
    "maybe",
    "possibly",
    "perhaps",
    "might be",
    "could be",
    "ไม่แน่ใจ",
    "อาจจะ",
    "น่าจะ",
    "คงจะ",
]

# Phrases of made-up content.
INVENTED = [
    "i made this up",
    "this is fictional",
    "i don't have information",
    "ไม่มีข้อมูล",
    "ไม่ทราบข้อมูล",
    "ไม่มีรายละเอียด",
]

# Personal data patterns, in the order that decides ties.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone_international": r"\+?\d{1,4}[\s\-]?\(?\d{1,3}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}",
    "phone_thai": r"0[0-9]{8,9}",
    "thai_id": r"\b\d{1}\s?\d{4}\s?\d{5}\s?\d{2}\s?\d{1}\b",
    "credit_card": r"\b(?:\d{4}[\s\-]?){3}\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "potential_name": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
    "thai_name": r"\b[ก-๙]+\s+[ก-๙]+\b",
}

# Confidence by personal data type.
PII_CONFIDENCE = {
    "email": 0.95,
    "phone_international": 0.85,
    "phone_thai": 0.90,
    "thai_id": 0.95,
    "credit_card": 0.90,
    "ssn": 0.95,
    "potential_name": 0.60,
    "thai_name": 0.70,
}
PII_CONFIDENCE_OTHER = 0.8

# Words that end a chat session.
EXIT_WORDS = ["quit", "exit", "bye", "ออก", "จบ", "เลิก"]
