"""Word lists and tables that results depend on."""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------------------------------------
URGENCY = ["urgent", "asap", "至急", "本日中", "今すぐ", "immediately"]
MONEY = ["wire", "transfer", "invoice", "送金", "振込", "振り込み", "請求書"]
ROUTE_CHANGE = ["don't call", "do not call", "電話しないで", "電話せず", "メールでのみ", "メールのみ", "change of bank", "振込先が変更"]
CHANNEL_MIGRATION = [
    "lineグループ", "lineで連絡", "lineに移動", "lineをください", "line group", "contact me on line", "add me on line",
    "teamsのチャット", "teamsで話", "teamsに移動", "contact on teams", "message me on teams", "switch to teams",
    "whatsappで", "whatsapp me", "message on whatsapp",
    "このメールを使わず", "別の方法で連絡", "don't use email", "use personal message", "smsで送って", "テキストで送って",
]
PERSUASION = {
    "authority": ["as ceo", "as the ceo", "ceo here", "this is ceo", "代表取締役", "社長より", "役員からの指示", "上層部からの", "on behalf of", "executive directive", "management directive", "i am the ceo", "per cfo", "per ceo"],
    "scarcity": ["before end of day", "eod today", "by close of business", "within the hour", "right now", "no later than", "本日中", "今日中", "今すぐ", "締め切り", "期限", "time sensitive", "time-sensitive", "act now", "deadline", "expires today", "last chance"],
    "commitment": ["as we discussed", "as agreed", "as previously discussed", "as i mentioned", "you promised", "per our conversation", "以前お話した", "ご承知のとおり", "既にご了承", "先日ご確認", "as per our last meeting", "following our call"],
    "social_proof": ["company policy", "company procedure", "corporate policy", "all staff", "everyone else has", "rest of the team", "社内ルール", "会社の方針", "全員が", "他の部署も", "standard procedure", "normal process", "routine transfer"],
    "liking": ["between us", "just between you and me", "keep this confidential", "don't tell anyone", "this is private", "personal matter", "内密に", "ここだけの話", "誰にも言わないで", "秘密で", "trust you with this", "i trust you"],
    "reciprocity": ["i've always trusted you", "i rely on you", "you've always come through", "count on you", "いつも頼りにしている", "あなたを信頼しているから", "you've never let me down", "i know i can count on you", "only you can handle this"],
}
HIGH_RISK_SUBJECTS = [
    "wire transfer", "bank transfer", "urgent payment", "immediate payment", "invoice", "urgent invoice", "overdue payment",
    "bitcoin", "ethereum", "crypto", "wallet", "btc", "eth",
    "password reset", "account suspended", "verify your account", "confirm your identity", "login attempt",
    "act now", "immediate action", "respond immediately",
    "至急", "緊急", "送金", "振込", "パスワード", "口座", "仮想通貨", "ビットコイン", "アカウント停止", "確認が必要",
]
WATCHED_DOMAINS = ["microsoft.com", "google.com", "amazon.com", "apple.com", "paypal.com", "linkedin.com", "dropbox.com", "docusign.com", "salesforce.com", "zoom.us", "office365.com", "outlook.com", "gmail.com", "yahoo.com", "facebook.com"]
MEMORY_PATTERNS = ["always recommend", "in the future", "remember to", "from now on", "ignore", "instead of", "今後は", "常に", "これからは"]
MEMORY_NEGATIONS = ["ではありません", "ではない", "しない", "じゃない", "ではなく", " not ", "n't ", " don't "]
OVERRIDE_PHRASES = [
    "ignore all previous", "ignore previous instructions", "disregard the above", "disregard all prior", "forget everything", "you are now", "new instructions:", "system override",
    "前の指示を無視", "これまでの指示を忘れ", "以前の指示を無視",
    "[pretend this conversation", "[now continue", "pretend you are",
    "ignoriere alle vorherigen", "ignoriere alle", "ignorez toutes les instructions", "ignorer les instructions précédentes",
    "忽略之前所有指示", "忽略先前的指令", "忘记以前的指示", "ignora todas las instrucciones anteriores", "olvida las instrucciones previas",
    "모든 이전 지시를 무시", "이전 지시를 잊어", "ignore todas as instruções anteriores", "esqueça as instruções anteriores",
    "ignora tutte le istruzioni precedenti", "dimentica le istruzioni precedenti", "игнорировать все предыдущие инструкции", "забудьте предыдущие инструкции",
    "[previous summary:", "[prior context:", "[conversation history:", "then execute:", "then perform:", "after translation:", "after summarizing:",
]
SPECIAL_TOKENS = ["<|im_start|>", "<|im_end|>", "<|system|>", "[INST]", "[/INST]", "<<sys>>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<start_of_turn>", "<end_of_turn>", "<|user|>", "<|assistant|>", "<|end|>", "###system", "### instruction", "### response"]
INSTRUCTION_MARKERS = ["## system:", "## instruction:", "system:", "forward this", "send this to", "転送して", "送信して"]
CLEARANCE_CLAIMS = [
    "is safe", "is legitimate", "is verified", "is trusted", "safe to open", "safe to click", "no threat", "no malware", "not phishing", "not a phishing", "verified by",
    "scanned and clean", "security check passed", "passed security", "cleared by", "dmarc pass", "spf pass", "dkim pass",
    "安全です", "安全なメール", "正規のメール", "検証済み", "認証済み", "確認済みです", "スキャン済み", "ウイルスチェック済", "脅威は検出され", "マルウェアは検出され", "セキュリティチームが確認", "信頼できる送信者",
]
EXFILTRATION_PARAMS = [
    "?data=", "&data=", "?content=", "&content=", "?msg=", "&msg=", "?text=", "&text=", "?body=", "&body=", "?payload=", "&payload=", "?info=",
    "&info=",
]
FINANCIAL = ["振込", "口座", "送金", "支払", "請求", "決済", "入金", "出金", "資金", "残高", "為替", "口座変更", "支払先", "wire transfer", "payment", "invoice", "deposit", "withdrawal", "bank account", "account change", "remittance", "swift code", "iban"]
VERIFY_URGENCY = ["至急", "緊急", "本日中", "今すぐ", "即時", "急いで", "urgent", "immediately", "asap", "right now", "today"]
CONFIDENTIAL = ["confidential", "机密", "機密", "秘密", "取扱注意", "restricted", "internal only", "社外秘", "極秘", "do not distribute", "not for distribution"]
PRIVILEGE = ["attorney-client", "privileged and confidential", "attorney client privilege", "legal advice", "弁護士秘匿特権", "法的助言"]
CODE_MARKERS = ["fn ", "def ", "class ", "import ", "use ", "pub mod", "#include", "namespace ", "function(", "const char*", "SELECT ", "FROM ", "WHERE "]
MEDICAL = ["diagnosis", "prescription", "patient id", "医療記録", "診断名", "処方箋", "患者id", "病名", "icd-10", "icd-11"]
FREE_MAIL = ["gmail.com", "yahoo.com", "yahoo.co.jp", "hotmail.com", "outlook.com", "live.com", "icloud.com", "protonmail.com", "yandex.com", "aol.com", "qq.com", "163.com"]
COUNTRIES = [
    "JP", "US", "GB", "DE", "FR", "IT", "ES", "NL", "BE", "CH", "AT", "SE", "NO", "DK", "FI", "IE", "PT", "GR", "PL", "CZ", "HU", "RO", "BG", "HR",
    "SK", "SI", "LT", "LV", "EE", "LU", "CA", "AU", "NZ", "CN", "KR", "HK", "SG", "TW", "TH", "MY", "ID", "PH", "VN", "IN", "PK", "BD", "AE", "SA",
    "IL", "TR", "ZA", "EG", "NG", "KE", "BR", "MX", "AR", "CL", "CO", "PE", "RU", "UA", "CY", "MT", "IS", "LI",
]
POLITE = (["ます", "です", "いただ", "ございます", "申し", "存じ"], ["please", "kindly", "would you", "sincerely", "regards"])
CASUAL = (["だよ", "じゃん", "ね〜", "かな", "だな"], ["hey", "thanks", "cheers", "gonna", "wanna"])
#: host suffix -> (kind, high risk)
MEETING_HOSTS = {
    "teams.microsoft.com": "teams", "teams.live.com": "teams", "slack.com": "slack", "zoom.us": "zoom", "zoom.com": "zoom", "meet.google.com": "meet",
    "wa.me": "whatsapp", "api.whatsapp.com": "whatsapp", "chat.whatsapp.com": "whatsapp", "whatsapp.com": "whatsapp",
    "t.me": "telegram", "telegram.me": "telegram", "telegram.org": "telegram", "signal.me": "signal", "signal.group": "signal",
}
DOCUMENT_HOSTS = {
    "docusign.net": "DocuSign", "docusign.com": "DocuSign", "drive.google.com": "Google Drive", "docs.google.com": "Google Docs", "onedrive.live.com": "OneDrive",
    "1drv.ms": "OneDrive", "sharepoint.com": "SharePoint", "dropbox.com": "Dropbox", "box.com": "Box",
}
#: Zero-width, bidirectional and format characters, as a regular-expression class; the screener also takes tags.
ZERO_WIDTH = r"\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}"
TAGS = r"\x{E0000}-\x{E007F}"
LOOKALIKES = {
    "а": "a", "α": "a", "е": "e", "ε": "e", "о": "o", "ο": "o", "р": "p", "ρ": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ν": "v",
    "Α": "A", "А": "A", "В": "B", "Β": "B", "С": "C", "Е": "E", "Ε": "E", "Н": "H", "Η": "H", "І": "I", "Ι": "I", "К": "K", "Κ": "K", "М": "M",
    "Μ": "M", "Ν": "N", "О": "O", "Ο": "O", "Р": "P", "Ρ": "P", "Т": "T", "Τ": "T", "Υ": "Y", "Х": "X", "Χ": "X", "Ζ": "Z",
}
# ----------------------------------------------------------------------------------------------------------
LOOKALIKES_FROM, LOOKALIKES_TO = "".join(LOOKALIKES), "".join(LOOKALIKES.values())
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_WIDTH = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
