"""Lookup tables (fixed values)."""

#: Source code extensions and their languages.
CODE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "cpp",
    ".h": "cpp", ".hpp": "cpp", ".go": "go", ".rs": "rust", ".php": "php", ".rb": "ruby", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
}
#: Parsers by extension: images, code, documents.
IMAGES = ("jpg", "jpeg", "png", "webp")
DOCUMENTS = ("doc", "docx", "wps", "epub", "html", "txt", "pdf", "ppt", "pptx", "xls", "xlsx", "csv", "md", "json")
