"""Phrases, extensions and limits that results depend on."""

# Queries that start with one of these were injected by the harness, not typed by a person.
INJECTED_PREFIXES = (
    "The beginning of the above subagent result", "The above subagent result", "A subagent has completed",
    "The background shell command", "Briefly inform the user about the task result",
)

STRONG_OPENERS = (
    "Now I'm ", "Now I'll ", "Now I ", "Now let me ", "Now, I", "Let me ", "Let's ", "I'll ", "I will ", "I need to ", "I need ", "I'm going ",
    "I am going ", "I'm planning", "I'm setting", "I'm mapping", "I'm looking", "I'm creating", "I'm working", "I'm checking", "I'm gonna ",
    "I plan ", "I should ", "First, I", "First I", "Next, I", "Next I", "Then I'll", "My plan", "My next", "My first", "Time to ",
)

WEAK_OPENERS = ("I'm ", "I am ", "I want ", "I see ", "I think ", "I notice", "I've ", "I have ", "I checked", "So I ", "The user ")

MARKERS = (
    "I need to", "I'll ", "I will ", "I'm ", "I am ", "I want ", "I should ", "I see ", "I think ", "I notice", "I plan ", "I can ", "I could ",
    "Let me ", "Let's ", "We need", "We'll ", "We should", "My first", "I have ", "I've ", "It's important", "It looks like", "It seems",
    "I wonder", "I consider", "I'm considering", "Maybe I", "So I", "the user's ", "I checked", "I did ", "I don't", "I won't", "I must ", "I may ", "I might ",
)

PLANNING = (
    "I need", "I'll", "I will", "Let me", "Let's", "I'm going", "I should", "I want", "I plan", "I have to", "I must", "I'm considering", "My plan",
)

INTENTS = (
    "Let me ", "Now I'll", "Now I will", "Now let me", "I'll now", "I will now", "Next, I'll", "Next I'll", "Next up, I", "Time to ",
    "Then I'll", "then I'll", "I'm going to ", "I am going to ", "I'll start", "I'll begin", "I'll run", "I'll check", "I'll look", "I'll read",
    "I'll open", "I'll fix", "I'll update", "I'll create", "I'll stage", "I'll write", "I'll add", "I'll apply",
)

EXTENSIONS = {
    "readable": "txt md markdown csv tsv json jsonl yaml yml toml xml html css js ts tsx jsx py rs go java c h cpp hpp sh rb swift kt sql log tex rst ini cfg conf",
    "document": "pdf docx doc odt rtf pptx ppt xlsx xls pages key numbers epub",
    "image": "png jpg jpeg gif webp bmp tiff tif svg heic ico",
    "video": "mov mp4 avi mkv webm m4v mpg mpeg",
    "audio": "wav m4a mp3 aac flac ogg opus aiff caf",
}
# Of the readable files only these are found in running text.
EXTRACTED_READABLE = "txt md markdown csv tsv"

# The type each extension is served as; HTML is served as text so that foreign pages never render.
MIME_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "bmp": "image/bmp", "ico": "image/x-icon", "heic": "image/heic", "tif": "image/tiff", "tiff": "image/tiff",
    "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo",
    "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "aac": "audio/aac", "flac": "audio/flac", "ogg": "audio/ogg", "opus": "audio/ogg",
    "aiff": "audio/aiff", "caf": "audio/x-caf", "pdf": "application/pdf",
    "md": "text/plain; charset=utf-8", "markdown": "text/plain; charset=utf-8", "txt": "text/plain; charset=utf-8", "log": "text/plain; charset=utf-8",
    "csv": "text/plain; charset=utf-8", "tsv": "text/plain; charset=utf-8", "json": "application/json", "jsonl": "application/json", "html": "text/plain; charset=utf-8",
}

TITLE_CHARS, TITLE_LINES, TITLE_BYTES = 90, 8, 512 * 1024
SNIPPET_CHARS, CONTEXT_BYTES = 200, 80
RESULT_CHARS = 16_000
PREVIEW_CHARS, SUMMARY_CHARS = 1_600, 66
SHOWN_TOOLS, SHOWN_IMAGES, SHOWN_FILES = 4, 5, 4
# The fields of a tool's input that tell what it did, the most telling first.
TELLING_FIELDS = ("path", "command", "query", "pattern", "url", "glob_pattern", "description")
FIND_CAP = SEARCH_CAP = 500
CHUNK_BYTES = 100_000
ATTACHMENT_BYTES = 2 << 20
MTIME_SLACK_S = 2

# Public credential formats; the texts of these patterns mean the same to Java and RE2.
SECRET_FAMILIES = {
    "aws": "(?:AKIA|ASIA)[0-9A-Z]{16}",
    "bearer": "(?i)bearer [A-Za-z0-9._~+/=-]{20,}",
    "github": "gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}",
    "google": "AIza[0-9A-Za-z_-]{35}",
    "huggingface": "hf_[A-Za-z0-9]{30,}",
    "openai": "sk-[A-Za-z0-9_-]{20,}",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.)*?-----END [A-Z ]*PRIVATE KEY-----",
    "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
}
