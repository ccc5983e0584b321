"""What the SQL of queries compares with, written out here so that a wrong value in the library shows."""

# Shapes of secrets, greetings, words of small talk.
PEM = r"""(?s)-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY-----"""
TOKEN = r"""(?i)\b(sk-[A-Za-z0-9_\-]{8,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|xox[baprs]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,})\b"""
KEY_VALUE = r"""(?i)(\b(?:api[_-]?key|apikey|secret|secret[_-]?key|password|passwd|pwd|token|access[_-]?token|access[_-]?key|auth|credential|private[_-]?key|client[_-]?secret|db_password|connection[_-]?string)\b\s*[:=]\s*)([\"']?[^\s\"',;]+[\"']?)"""
GREETINGS = [
    "merhaba", "selam", "hello", "hi", "hey", "nasılsın", "nasilsin", "how are you", "iyiyim", "teşekkür", "tesekkur", "thanks", "thank you",
    "günaydın", "gunaydin", "iyi günler", "iyi gunler", "iyi akşamlar", "iyi aksamlar", "iyi geceler", "mrb", "sa", "as", "naber",
]
SOCIAL_ONLY = [
    "nasıl", "nasil", "nerede", "kim", "ne", "what", "who", "where",
]
