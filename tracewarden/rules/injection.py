"""Input rules: injection phrases, role confusion, hidden Unicode."""

from __future__ import annotations

from tracewarden.dialect import Pattern
from tracewarden.rules.base import rule

# Rule ids, severities and patterns that reports must reproduce.
INJECTION = (
    rule("role_hijack_ignore",
         r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier|preceding)\s+instructions", "i",
         severity="high", needs=(("ignore",), ("instructions",))),
    rule("role_hijack_disregard",
         r"disregard\s+(?:all\s+)?(?:previous|prior|above|earlier|your)\s+(?:instructions|directives|rules|guidelines)", "i",
         severity="high", needs=(("disregard",),)),
    rule("role_hijack_forget",
         r"forget\s+(?:all\s+)?(?:previous|prior|above|earlier|your)\s+(?:instructions|directives|rules|context)", "i",
         severity="high", needs=(("forget",), ("instructions", "directives", "rules", "context"))),
    rule("role_hijack_new_instructions",
         r"(?:your\s+new\s+instructions\s+are|from\s+now\s+on\s+you\s+(?:are|will|must|should))", "i",
         severity="high", needs=(("instructions", "now"), ("your", "from"))),
    rule("role_hijack_override", r"system\s*prompt\s*override", "i",
         severity="high", needs=(("system",), ("prompt",), ("override",))),
    rule("role_hijack_act_as",
         r"(?:you\s+are\s+now|act\s+as|pretend\s+(?:to\s+be|you\s+are))\s+(?:DAN|an?\s+unrestricted|an?\s+unfiltered|jailbroken|evil)", "i",
         severity="high", needs=(("you", "act", "pretend"), ("dan", "unrestricted", "unfiltered", "jailbroken", "evil"))),
    rule("jailbreak_dan", r"\bDAN\s*(?:mode|prompt|jailbreak|\d+\.\d+)\b", "i",
         severity="high", needs=(("dan",), ("mode", "prompt", "jailbreak", "."))),
    rule("jailbreak_developer_mode", r"(?:developer|god)\s*mode\s*(?:enabled|activated|on)\b", "i",
         severity="high", needs=(("mode",), ("developer", "god"))),
    rule("jailbreak_do_anything_now", r"do\s+anything\s+now", "i",
         severity="high", needs=(("anything",),)),
    rule("chat_template_inst", r"\[INST\]|\[\/INST\]",
         severity="high", needs=(("inst]",),)),
    rule("chat_template_im", r"<\|im_start\|>|<\|im_end\|>",
         severity="high", needs=(("<|im_",),)),
    rule("chat_template_special", r"<\|(?:system|user|assistant|endof(?:text|turn)|sep|pad)\|>",
         severity="high", needs=(("<|",), ("|>",))),
    rule("base64_block", r"(?:^|[\s:=])([A-Za-z0-9+/]{100,}={0,2})(?:$|[\s])", "m",
         severity="medium", probe=Pattern(r"[A-Za-z0-9+/]{100}")),
    rule("html_hidden_text", r"<!--[\s\S]*?(?:ignore|instruction|system|prompt|override)[\s\S]*?-->", "i",
         severity="medium", anchor="<!--",
         needs=(("<!--",), ("-->",), ("ignore", "instruction", "system", "prompt", "override"))),
    rule("html_invisible_style",
         r"""style\s*=\s*["'][^"']*(?:font-size\s*:\s*0|display\s*:\s*none|visibility\s*:\s*hidden|color\s*:\s*(?:white|#fff(?:fff)?|rgba?\([^)]*,\s*0\)))[^"']*["']""", "i",
         severity="medium", needs=(("style",), ("font-size", "display", "visibility", "color"))),
    rule("prompt_leak_request",
         r"(?:reveal|show|display|output|print|repeat|echo)\s+(?:your\s+)?(?:system\s+prompt|instructions|initial\s+prompt|hidden\s+prompt|original\s+prompt)", "i",
         severity="medium", needs=(("prompt", "instructions"),)),
)

# Tried in this order, the first hit is reported.
ROLE_CONFUSION = (
    Pattern(r"\bas\s+an?\s+AI\b.*?\byou\s+(?:must|should|will|are)\b", "i"),
    Pattern(r"\byou\s+are\s+an?\s+(?:helpful|AI|language\s+model|assistant)\b", "i"),
    Pattern(r"\brespond\s+(?:only\s+)?(?:in|with)\b.*?\bformat\b", "i"),
    Pattern(r"\balways\s+(?:respond|reply|answer|say)\b", "i"),
    Pattern(r"\bnever\s+(?:mention|reveal|disclose|say|tell)\b", "i"),
)

# Fixed value: zero-width, direction-changing and otherwise invisible characters.
SUSPICIOUS_UNICODE = Pattern(
    r"[\u200B-\u200F\u2028-\u202F\uFEFF\u061C\u115F\u1160\u17B4\u17B5\u180E"
    r"\u2000-\u200A\u2060-\u2064\u2066-\u2069\u206A-\u206F]|\u00AD|\u034F"
)

TRUSTED_ROLES = ("system", "developer")
