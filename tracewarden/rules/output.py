"""Output rules: banned strings, blocked domains, dangerous code, URL shape."""

from __future__ import annotations

from tracewarden.dialect import Pattern
from tracewarden.rules.base import rule

# Jailbreak and image-injection markers, then the standard test strings.
BANNED = (
    "[DAN]",
    "DAN:",
    "DAN Mode enabled",
    "ANTI-DAN:",
    "[\U0001F513JAILBREAK]",
    "successfully jailbroken",
    "STAN:",
    "DUDE:",
    "(\U0001F513Developer Mode Output)",
    "![http",
    "X5O!P%@AP[4\\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*",
    "XJS*C4JDBQADN1.NSBN3*2IDNEN*GTUBE-STANDARD-ANTI-UBE-TEST-EMAIL*C.34X",
    "XJS*C4JDBQADN1.NSBN3*2IDNEN*GTPHISH-STANDARD-ANTI-PHISH-TEST-EMAIL*C.34X",
)

# Ids, severities and patterns, in report order.
DANGEROUS_CODE = (
    rule("shell_exec", r"eval\s*\(\s*atob\s*\(", "i", severity="high", needs=(("eval",), ("atob",))),
    rule("shell_exec", r"eval\s*\(\s*Buffer\.from.*base64", "i", severity="high", needs=(("eval",), ("buffer.from",))),
    rule("shell_exec", r"exec\s*\(\s*atob\s*\(", "i", severity="high", needs=(("exec",), ("atob",))),
    rule("shell_exec", r"child_process.*exec\s*\(", "i", severity="high", needs=(("child_process",),)),
    rule("shell_exec", r"subprocess.*shell\s*=\s*True", "i", severity="medium", needs=(("subprocess",),)),
    rule("shell_exec", r"os\.system\s*\(", "i", severity="medium", needs=(("os.system",),)),
    rule("fs_access", r"""fs\.writeFile\s*\(\s*['"]\/etc\/passwd""", "i", severity="high", needs=(("/etc/passwd",),)),
    rule("fs_access", r"open\s*\([^)]*\/etc\/shadow", "i", severity="high", needs=(("/etc/shadow",),)),
    rule("exfil", r"""fetch\s*\(\s*['"]https?:\/\/[^/]*\/exfiltrate""", "i", severity="high", needs=(("/exfiltrate",), ("fetch",))),
    rule("exfil", r"requests\.post\s*\([^)]*\/exfiltrate", "i", severity="high", needs=(("/exfiltrate",), ("requests.post",))),
    rule("exfil", r"axios\.post\s*\([^)]*\/exfiltrate", "i", severity="high", needs=(("/exfiltrate",), ("axios.post",))),
)

# Fixed values.
BLOCKED_DOMAINS = ("evil.com", "malware.test", "phishing.test", "exfiltrate.me", "datatheft.io")

# Everything from $ to _ in ASCII order, plus lower-case letters and the exclamation mark.
# One character class, so that Java matches long URLs without recursion.
URL = Pattern(r"https?:\/\/[a-z!$-_]+")

REDACTED = "[REDACTED]"
