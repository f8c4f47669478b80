"""Tables that must equal their public definitions for right results."""

# Severities, weakest first.
SEVERITIES = ("low", "medium", "high", "critical")

# Code point classes.
TAG = r"\x{E0000}-\x{E007F}"
BIDI = r"\x{202A}-\x{202E}\x{2066}-\x{2069}"
MARK = r"\x{200E}\x{200F}\x{061C}"
VARIATION = r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
INVISIBLE = r"\x{200B}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{00AD}\x{180E}\x{115F}\x{1160}\x{3164}\x{FFA0}"
JOINER_SCRIPT = r"\x{0600}-\x{06FF}\x{0700}-\x{07FF}\x{0870}-\x{08FF}\x{0900}-\x{0DFF}\x{0F00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
EMOJI = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 "
    "25FB-25FE 2600-2605 2607-2612 2614-2685 2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E "
    "2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 "
    "1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1FF 1F201-1F20F 1F21A 1F22F "
    "1F232-1F23A 1F23C-1F23F 1F249-1F3FA 1F400-1F53D 1F546-1F64F 1F680-1F6FF 1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F "
    "1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD"
)
CYRILLIC_LIKE = "аеорсухіјѕһԛԝցАВЕКМНОРСТХЅІЈԁ"
GREEK_LIKE = "οναρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϹ"
WORD_LETTERS = r"A-Za-z\x{0370}-\x{03FF}\x{0400}-\x{04FF}\x{0500}-\x{052F}"

# Words whose presence shortly before negates a directive.
NEGATORS = "never|not|don't|dont|doesn't|didn't|shouldn't|mustn't|won't|cannot|can't|avoid|avoids|avoiding|refrain|prevent|prevents|preventing|stop|forbid|prohibit|discourage"
_VERBS = "send|post|upload|transmit|exfiltrate|leak|forward|email|publish|share"
_NEGATED = rf"(?<!\m(?:{NEGATORS})\M[\sA-Za-z0-9_'\"-]{{0,25}})"

# Phrase rules (type, severity, pattern, ignore case), in order.
PHRASES = (
    ("Chat Template Token Injection", "critical", r"<\|(?:im_start|im_end|system|endoftext|eot_id|start_header_id|end_header_id|assistant|user)\|>", True),
    ("Instruction Delimiter Injection", "high", r"\[(?:/?INST|/?SYS)\]|</?(?:system|human|assistant)>", True),
    ("Instruction Override", "high", r"\m(?:ignore|disregard|forget|override|bypass)\s+(?:(?:all|any|the)\s+)*+(?:previous|prior|above|preceding|earlier|foregoing|original|system|initial)\s+(?:instructions?|prompts?|rules?|directions?|commands?|guidelines?|constraints?|context)", True),
    ("Instruction Override", "high", r"\mforget\s+(?:everything|all)\s+(?:you|that|above|before|previously)\M", True),
    ("New Instruction Injection", "high", r"\m(?:new|updated|revised|real|actual|true)\s+(?:instructions?|system\s+prompt|rules?|directive)s?\s*[:\x{2014}-]", True),
    ("User Concealment Directive", "critical", r"\m(?:do\s+not|don't|never)\s+(?:tell|inform|mention\s+(?:this\s+)?to|reveal\s+(?:this\s+)?to|alert|notify|warn|show)\s+(?:the\s+|this\s+to\s+the\s+)?(?:user|human|developer|operator|owner)\M", True),
    ("User Concealment Directive", "critical", r"\mwithout\s+(?:telling|informing|notifying|alerting|asking|warning|the\s+knowledge\s+of)\s+(?:the\s+)?(?:user|human|developer|operator)\M", True),
    ("Silent Execution Directive", "high", r"\m(?:silently|quietly|secretly|covertly|discreetly)\s+(?:run|execute|perform|send|post|add|insert|modify|append|write|install|fetch)\M", True),
    ("Exfiltration Directive", "critical", rf"\m(?=(?:{_VERBS})\s){_NEGATED}(?:{_VERBS})\s+(?:(?:me|us|the|all|your|any)\s+)*+(?:contents?\s+of\s+)?(?:\.env\M|env(?:ironment)?\s+(?:vars?|variables?)|credentials?|secrets?|api[\s_-]*keys?|access[\s_-]*tokens?|private[\s_-]*keys?|ssh[\s_-]*keys?|password)", True),
    ("Exfiltration Command", "critical", r"\m(?:curl|wget|fetch|Invoke-WebRequest|iwr)\M[^\n]{0,200}\$\(\s*(?:cat|printenv|env|type)\M", True),
    ("Decode-and-Execute Payload", "critical", r"\mbase64\s+(?:-d|-D|--decode)\M[^\n]{0,120}\|\s*(?:sh|bash|zsh|python[0-9.]*|node|perl|ruby)\M", True),
    ("Remote Script Execution", "medium", r"\m(?:curl|wget)\M[^\n]{0,200}\|\s*(?:sudo\s+)?(?:sh|bash|zsh)\M", True),
    ("System Prompt Extraction", "high", r"\m(?:reveal|repeat|print|output|echo|show|display|disclose|summar(?:ise|ize))\s+(?:me\s+)?(?:your|the|all)\s+(?:system\s+prompt|initial\s+(?:prompt|instructions?)|instructions?|prompt\s+text|guidelines|configuration)", True),
    ("AI-Directed Instruction", "high", r"\m(?:IMPORTANT|ATTENTION|URGENT|WARNING|NOTICE)\M\s*[:!-]{0,2}[^\n]{0,30}?\m(?:for|to)\s+(?:the\s+)?(?:AI|LLM|assistant|agent|model|Claude|Copilot|Cursor|ChatGPT|GPT|Gemini|Codex)\M", False),
    ("AI-Directed Instruction", "high", r"\m(?:NOTE|MESSAGE|INSTRUCTIONS?|DIRECTIVE)\s+(?:TO|FOR)\s+(?:THE\s+)?(?:AI|ASSISTANT|LLM|AGENT|MODEL|CLAUDE|COPILOT|CURSOR)\M", False),
    ("AI-Directed Instruction", "medium", r"\m(?:AI|LLM|assistant|agent|Claude|Copilot|Cursor|ChatGPT|Gemini|Codex)\s*[,:]\s*(?:please\s+)?(?:ignore|disregard|stop|instead|note\s+that|you\s+must|you\s+should|do\s+not|always)\M", True),
    ("Role Reassignment", "medium", r"\myou\s+are\s+(?:now|no\s+longer)\s+(?:a|an|in|the)\M|\mfrom\s+now\s+on,?\s+you\s+(?:will|must|shall|are)\M|\mact\s+as\s+(?:if\s+you\s+are\s+)?(?:a|an|though)\M", True),
    ("Safety Bypass Attempt", "high", r"\m(?:developer|debug|god|admin|root|maintenance|unrestricted|DAN)\s+mode\s+(?:enabled?|activated?|on\M)|\m(?:disable|turn\s+off|suspend|ignore)\s+(?:your\s+|all\s+)?(?:safety|security|content)\s+(?:filters?|guidelines?|checks?|restrictions?|policies)", True),
    ("Dependency Tampering Directive", "high", r"\m(?:add|install|include|require|import)\s+(?:the\s+)?(?:package|dependency|module|library)\s+[`'\"][^`'\"\n]{2,60}[`'\"]\s*(?:to\s+(?:package\.json|requirements\.txt|the\s+project)|before\s+(?:you\s+)?(?:continue|proceed|answer))", True),
)

# Patterns of the command detector.
SECRET_FILE = r"\.env\M(?!\.(?:example|sample|template|dist))|\.env\.(?!example|sample|template|dist)[a-z]|\mid_(?:rsa|dsa|ecdsa|ed25519)\M|\.pem\M|\.key\M|\.p12\M|\.pfx\M|\mcredentials\M|\.npmrc\M|\.pypirc\M|\.netrc\M|\.git-credentials\M|\mkubeconfig\M|\msecrets?\.[a-z]|serviceAccount"
ENV_DUMP = r"\mprintenv\M|\menv\M\s*[|>]|\mset\M\s*[|>]|/proc/self/environ|\mGet-ChildItem\s+Env:|\mgci\s+env:"
URL_TOOL = r"(?<![A-Za-z0-9_/.\-])(?:curl|wget|Invoke-WebRequest|Invoke-RestMethod|iwr|irm|bitsadmin|certutil)\M"
BARE_TOOL = r"(?<![A-Za-z0-9_/.\-])(?:nc|ncat|netcat|telnet|scp|sftp|rsync|ssh|ftp|ping|nslookup|dig|doggo|resolvectl)\M"
ANY_URL = r"\m[a-z][a-z0-9+.-]*://([^\s'\"`;|)&]+)"
STAGING_TOOL = r"\m(?:cp|copy|mv|move|tar|zip|7z|gzip|base64|xxd|openssl\s+enc|Copy-Item)\M"
STAGING_DEST = r"(?:^|\s|>)(?:/tmp/|/var/tmp/|%TEMP%|%TMP%|\$env:TEMP|C:\\Windows\\Temp|/dev/shm/)|>\s*(?:~/|\$HOME/)"
GIT_PUSH = r"\mgit\s+(?:remote\s+(?:add|set-url)|push)\M"

# Tools that read, file kinds, globs, ignore files, deny rules.
READ_TOOLS = ("Read", "WebFetch", "Fetch", "WebSearch", "NotebookRead", "Glob", "Grep")
STRIPPABLE_TYPES = ("Unicode Tag Smuggling", "Bidirectional Text Override", "Variation Selector Smuggling", "Invisible Character Sequence")
CODE_EXTENSIONS = (
    "ts", "js", "tsx", "jsx", "mjs", "cjs",
    "py", "rb", "go", "java", "cs", "php",
    "rs", "sh", "ps1", "env", "yaml", "yml",
    "json", "jsonc", "toml", "ini", "cfg", "conf",
    "xml", "properties",
)
PROSE_EXTENSIONS = (
    "md", "mdc", "mdx", "txt", "rst",
)
RULE_FILES = (".cursorrules", ".clinerules", ".windsurfrules", ".roorules", ".aiderules", ".rules")
EXCLUDED = ("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/out/**", "**/*.min.*", "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/.next*/**", "**/.nuxt/**", "**/.vercel/**", "**/_next/**", "**/static/chunks/**")
ENV_EXCLUDED = EXCLUDED[:5]
SHIELD_GLOBS = (
    "**/.env", "**/.env.*", "!**/.env.example", "!**/.env.sample", "!**/.env.template", "**/secrets.*",
    "**/secret.*", "**/*.pem", "**/*.key", "**/*.p12", "**/*.pfx", "**/credentials.json",
    "**/credentials.yml", "**/credentials.yaml", "**/serviceAccountKey.json", "**/*_rsa", "**/*_dsa", "**/*_ecdsa",
    "**/*_ed25519", "**/.netrc", "**/.npmrc", "**/.pypirc", "**/.git-credentials", "**/config/secrets*",
    "**/vault.*", "**/.mcp.json", "**/mcp.json", "**/.cursor/mcp.json", "**/.vscode/mcp.json", "**/.windsurf/mcp_config.json",
    "**/claude_desktop_config.json",
)
IGNORE_FILES = (
    ".cursorignore", ".cursorindexingignore", ".codeiumignore", ".windsurfignore", ".aiexclude", ".antigravityignore",
    ".geminiignore", ".aiderignore", ".clineignore", ".rooignore", ".augmentignore", ".aiignore",
    ".llmignore",
)
DENY_RULES = (
    "Read(.env)", "Read(**/.env)", "Read(**/.env.*)", "Read(**/*.pem)", "Read(**/*.key)", "Read(**/*.p12)",
    "Read(**/*.pfx)", "Read(**/id_rsa)", "Read(**/id_dsa)", "Read(**/id_ecdsa)", "Read(**/id_ed25519)", "Read(**/credentials)",
    "Read(**/credentials.json)", "Read(**/serviceAccountKey.json)", "Read(**/.npmrc)", "Read(**/.pypirc)", "Read(**/.netrc)", "Read(**/.git-credentials)",
    "Read(**/.mcp.json)", "Read(**/mcp.json)",
)
SETTINGS_FILE = ".claude/settings.json"
COVERAGE = (  # tool, file, blocks indexing, a terminal bypasses it
    ("Cursor", ".cursorignore", True, True),
    ("Windsurf", ".codeiumignore", True, True),
    ("Gemini CLI", ".geminiignore", True, True),
    ("Antigravity / Code Assist", ".aiexclude", True, True),
    ("JetBrains AI", ".aiignore", True, True),
    ("Aider", ".aiderignore", True, True),
    ("Cline / Roo", ".clineignore / .rooignore", True, True),
    ("GitHub Copilot", "none", False, True),
    ("Claude Code", ".claude/settings.json", True, False),
)

# Of tool-server configurations, the blocks that hold credentials, the keys whose
# text a model sees, whole values that only refer to a variable, and file names.
CREDENTIAL_BLOCKS = ("env", "headers", "requestInit", "auth")
INDIRECT = r"\s*(?:\$\{[^}]{1,256}\}|\$[A-Za-z_][A-Za-z0-9_]{0,127}|%[A-Za-z_][A-Za-z0-9_]{0,127}%)\s*\Z"
MODEL_FACING = r"(?:description|instructions?|prompt|summary|title)\Z"
CONFIG_FILES = (".mcp.json", "mcp.json", "claude_desktop_config.json")
CONFIG_BELOW = ("mcp_config.json", (".windsurf", ".codeium"))
