"""The lists and limits that results depend on. Order matters where the first match wins."""

# Fixed values: (substring of the lower-cased user agent, crawler name); the first that is contained wins.
BOTS = [
    ("googlebot/", "Google Bot"), ("adsbot-google", "Google AdsBot"), ("mediapartners-google", "Google MediaPartners"), ("googleweblight", "Google WebLight"),
    ("googlebot-image", "Google Img Bot"), ("googlebot-video", "Google Video Bot"), ("googlebot-news", "Google News Bot"), ("storebot-google", "Google StoreBot"),
    ("google-inspectiontool", "Google Insp. Tool"), ("googleother", "Google Other"), ("googleother-image", "Google Other Img"), ("googleother-video", "Google Other Video"),
    ("google-read-aloud", "Google R.Aloud"), ("google-clouvertexbot", "Google Cloud Vertex"), ("google-extended", "Google Extended"), ("bingbot", "Bing"),
    ("googleimageproxy", "Goog. Img Proxy"), ("yandex", "Yandex"), ("baiduspider", "Baidu"), ("duckduckgo", "DuckDuckGo"), ("sogou", "Sogou"), ("exabot", "Exabot"),
    ("petalbot", "PetalBot"), ("yeti", "Naver Yeti"), ("seznambot", "Seznam Bot"), ("coccocbot", "CocCoc Bot"), ("mail.ru_bot", "Mail.RU Bot"), ("qwantify", "Qwantify"),
    ("mojeekbot", "MojeekBot"), ("ia_archiver", "Alexa Crawler"), ("archive.org_bot", "Archive.org Bot"), ("commoncrawl", "CommonCrawl"), ("sogou news spider", "Sogou News Spider"),
    ("daumua", "Daumua"), ("applebot", "AppleBot"), ("gptbot", "GPTBot"), ("chatgpt", "ChatGPT-User"), ("oai-searchbot", "OpenAI SearchBot"), ("oai-adsbot", "OpenAI AdsBot"),
    ("semrush", "Semrush"), ("ahrefs", "Ahrefs"), ("moz.com", "Moz"), ("rocket", "WP Rocket"), ("dompdf", "DomPdf bot"), ("wordpress", "Wordpress Bot"), ("meta-", "Meta Bot"),
    ("cortex", "Cortex"), ("aiohttp", "AioHttp"), ("scala", "Scala Bot"), ("facebook", "Meta Bot"), ("python", "Python Bot"), ("httpx", "Httpx Bot"), ("node", "Node Bot"),
    ("iframely", "Iframely Bot"), ("networkingextension", "Network Bot"), ("php/", "PHP Bot"), ("typhoeus", "Typhoeus Bot"), ("hubspot", "Hubspot Bot"), ("expanse", "Expanse Bot"),
    ("claudebot", "Claude Bot"), ("anthropic", "Claude Bot"), ("claude-user", "Claude Bot"), ("google-notebooklm", "Google NotebookLM"), ("perplexitybot", "Perplexity Bot"),
    ("perplexity-comet", "Perplexity Bot"), ("duckassistbot", "DuckAssist Bot"), ("meta-externalagent", "Meta Bot"), ("bytespider", "Bytespider"), ("grokbot", "Grok Bot"),
    ("xai-grok", "Grok Bot"), ("ccbot", "CommonCrawl"), ("firecrawl", "Firecrawl"), ("kadoa", "Kadoa"), ("tavily", "Tavily"), ("spaziodati", "SpazioDati"), ("excon", "Excon"), ("okhttp", "OkHttp"),
]

# Keywords whose surrounding token names an unlisted crawler, and browsers; the first that is contained wins.
GENERIC_BOTS = ["crawler", "spider", "sistrix", "chat", "uptime", "bot", "google", "rocket "]
BROWSERS = ["chrome", "firefox", "safari", "edge", "opera"]

# Fixed values: (file type, path endings), the first that fits wins; paths without a dot are HTML.
FILE_TYPES = [
    ("Image", [".jpg", ".svg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".ico"]), ("Video", [".mp4", ".mov", ".avi", ".mkv"]), ("Audio", [".mp3", ".wav", ".flac", ".aac"]),
    ("PHP", [".php"]), ("TXT", [".txt"]), ("CSS", [".css"]), ("JS", [".js"]), ("Document", [".pdf"]), ("HTML", [".html", ".htm", "/"]),
    ("Archive", [".zip", ".rar", ".tar", ".gz"]), ("Font", [".woff", ".woff2", ".ttf"]),
]

# Fixed values: (substring of the lower-cased referer, category), the first that is contained wins.
REFERERS = [
    ("google.com", "Google"), ("google.co", "Google"), ("bing.com", "MS Bing"), ("yahoo.com", "Yahoo"), ("duckduckgo.com", "DuckDuckGo"), ("baidu.com", "Baidu"),
    ("yandex.com", "Yandex"), ("yandex.ru", "Yandex"), ("facebook.com", "Facebook"), ("fb.com", "Facebook"), ("twitter.com", "Twitter/X"), ("x.com", "Twitter/X"),
    ("linkedin.com", "LinkedIn"), ("instagram.com", "Instagram"), ("pinterest.com", "Pinterest"), ("reddit.com", "Reddit"), ("tiktok.com", "TikTok"), ("github.com", "GitHub"),
    ("youtube.com", "YouTube"), ("stackoverflow.com", "Stack Overflow"), ("medium.com", "Medium"), ("wordpress.com", "WordPress"), ("blogger.com", "Blogger"), ("quora.com", "Quora"),
    ("vimeo.com", "Vimeo"), ("wikipedia.org", "Wikipedia"), ("amazon.com", "Amazon"), ("ebay.com", "eBay"), ("etsy.com", "Etsy"), ("shopify.com", "Shopify"),
]
LOCAL_REFERERS = ["localhost", "127.0.0.1", "::1"]

# Further referer categories that only the filter knows, as LIKE patterns.
REFERER_FILTERS = {
    "Android App": ["android-app://%"], "iOS App": ["ios-app://%"], "Browser Bookmark": ["%bookmark%", "%favorite%"], "Chrome Extension": ["chrome-extension://%"],
    "Email": ["mail.%", "%email%"], "News": ["news.%"], "Blog": ["blog.%"],
}

# Fixed values: (substring of the lower-cased user agent, category).
UA_BOTS = [
    ("googlebot", "Googlebot"), ("bingbot", "Bingbot"), ("slurp", "Yahoo Slurp"), ("duckduckbot", "DuckDuckGo Bot"), ("baiduspider", "Baidu Spider"),
    ("yandexbot", "Yandex Bot"), ("facebookexternalhit", "Facebook Bot"), ("twitterbot", "Twitter Bot"), ("linkedinbot", "LinkedIn Bot"), ("applebot", "Apple Bot"),
]
UA_ANY_BOT = ["bot", "crawler", "spider"]
UA_TOOLS = [("curl", "cURL"), ("wget", "Wget"), ("postman", "Postman"), ("python", "Python Requests")]
UA_BROWSER_WORDS = ["chrome", "firefox", "safari", "edge", "opera", "trident", "msie"]

# The groups of AI crawlers, by crawler name.
INDEXING_BOTS = ["Google Bot", "Bing", "Yandex", "Baidu", "DuckDuckGo", "Sogou", "Exabot", "PetalBot", "Naver Yeti", "Seznam Bot", "CocCoc Bot", "Mail.RU Bot", "Qwantify", "MojeekBot", "Alexa Crawler", "Archive.org Bot", "CommonCrawl", "Sogou News Spider", "Daumua", "AppleBot", "GPTBot", "OpenAI SearchBot"]
RETRIEVAL_AGENTS = ["GPTBot", "OAI-SearchBot", "ChatGPT-User", "OAI-AdsBot", "ClaudeBot", "Claude-User", "anthropic-ai", "Google-Extended", "Google-NotebookLM", "Google-CloudVertexBot", "PerplexityBot", "Perplexity-Comet", "DuckAssistBot", "Meta-ExternalAgent", "Bytespider", "GrokBot", "xAI-Grok", "CCBot", "Firecrawl", "Kadoa", "Exabot", "Tavily"]
AGENTIC_BOTS = ["Perplexity-Comet", "OAI-DeepResearch", "YouBot-ARI", "Grok-DeepSearch", "Claude-Researcher", "DuckAssistBot", "ChatGPT-User", "Claude-User", "Gemini-Live-Bot", "Tavily", "Search1api", "JinaBot", "Firecrawl", "Kadoa", "Google-CloudVertexBot", "LangChain-Agent", "AutoGPT-Retrieval"]

# What makes a path unimportant, as case-insensitive LIKE patterns.
UNIMPORTANT = ["filter", "sort", "order", "facet", "price", "color", "size", "search", "find", "tag", "page", "utm_", "gclid", "fbclid"]

# Reasons of HTTP status codes.
STATUS_TEXT = {200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 408: "Request Timeout", 410: "Gone", 429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}

# Substrings of addresses that aren't worth fetching.
SKIPPED = ["wp-admin", "wp-login", "javascript:", "mailto:", "tel:", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".css", ".js", ".zip", ".tar", ".tar.gz", ".tgz", ".gz", ".pdf"]

# Grams of CO2 per page, upper bounds of the ratings.
CARBON = [(0.095, "A+"), (0.186, "A"), (0.341, "B"), (0.493, "C"), (0.656, "D"), (0.846, "E")]

# What the content-type tabs look for, as patterns of the lower-cased type, and the words that keep a type out of "other".
CONTENT_TABS = {"html": "html", "javascript": "javascript|ecmascript", "css": "css", "images": "^image", "media": "^video|^audio", "fonts": "font", "xml": "xml", "pdf": "pdf"}
CONTENT_WORDS = ["html", "javascript", "ecmascript", "css", "image", "video", "audio", "font", "xml", "pdf"]

# Names and priorities of the issues, by id.
ISSUES = {
    1: ("Missing Page Title", "High"), 2: ("Missing Description", "High"), 3: ("Duplicated Titles", "High"), 4: ("Page Title > 60 Chars", "Medium"), 5: ("Page Title < 30 Chars", "Medium"), 6: ("Duplicated Descriptions", "Medium"),
    7: ("Descriptions > 160 Chars", "Medium"), 8: ("4XX Client Error", "High"), 9: ("5XX Server Error", "High"), 10: ("H1 Missing", "High"), 11: ("H2 Missing", "Low"), 12: ("Multiple H1 tags", "Medium"),
    13: ("Canonical Missing", "Medium"), 14: ("Canonical Mismatch", "Medium"), 15: ("NoIndex Pages", "Medium"), 16: ("NoFollow Pages", "Medium"), 17: ("Images Missing Alt Text", "Low"), 18: ("Broken Images", "High"),
    19: ("Large Images (>100KB)", "Medium"), 20: ("Slow Response (>2s)", "High"), 21: ("Large HTML Page (>100KB)", "Low"), 22: ("Thin Content (<300 words)", "Low"), 23: ("Non-HTTPS Pages", "High"), 24: ("Long Redirect Chains", "Medium"),
    25: ("Missing Schema", "Medium"), 26: ("Deeply Nested URLs (4+ Depth)", "Low"), 27: ("Missing OpenGraph Tags", "Low"), 28: ("Blocked by Robots.txt", "High"), 29: ("Redirect Detected", "Medium"), 30: ("URL Has Uppercase Characters", "Low"),
    31: ("URL Too Long (>100 chars)", "Low"), 32: ("URL Contains Special Characters", "Low"), 33: ("Low Readability Score", "Medium"), 34: ("Low Text-to-HTML Ratio", "Low"), 35: ("Missing Language Attribute", "Low"), 36: ("Too Many Internal Links (>150)", "Medium"),
    37: ("Too Many External Links (>50)", "Low"), 38: ("Inline CSS Detected", "Low"), 39: ("Mixed Content Detected", "High"), 40: ("Unsafe Cross-Origin Links", "Medium"), 41: ("Not Mobile-Friendly", "High"), 42: ("Cookies Detected", "Low"),
    43: ("Duplicated H2", "Low"), 44: ("Broken Outgoing Links", "High"),
}

# What makes an inline script risky.
RISKY_SCRIPTS = ["fetch(", "XMLHttpRequest", "window.open", "document.cookie", "eval(", "setTimeout(", "setInterval("]

# Fixed values: (pattern, whatever its case, label, category) of paths that only attackers and leaks ask for; the first that matches wins.
# Entries that repeat an earlier pattern can't win and aren't listed.
DANGEROUS_PATHS = [
    (r"\.env$", "Environment file", "sensitive"),
    (r"\.env\.\w+$", "Environment file", "sensitive"),
    (r"\.json(?:eger)?$", "JSON config", "config"),
    (r"config\.", "Config file", "config"),
    (r"\.conf(?:ig)?$", "Config file", "config"),
    (r"\.ini$", "INI config", "config"),
    (r"\.xml$", "XML config", "config"),
    (r"\.yml$", "YAML config", "config"),
    (r"\.yaml$", "YAML config", "config"),
    (r"\.toml$", "TOML config", "config"),
    (r"wp-config\.php", "WordPress config", "config"),
    (r"\.sql$", "SQL dump", "backup"),
    (r"\.bak$", "Backup file", "backup"),
    (r"\.old$", "Old file", "backup"),
    (r"\.(?:tar|gz|zip|rar|7z)$", "Archive", "backup"),
    (r"\.dump$", "Database dump", "backup"),
    (r"~$", "Backup/temp", "backup"),
    (r"(?:^|/)\.git/", "Git folder", "internal"),
    (r"(?:^|/)\.svn/", "SVN folder", "internal"),
    (r"(?:/|%2e)%2e(?:/|%2e)", "Path traversal", "exploit"),
    (r"\.\.(?:/|%2f)", "Path traversal", "exploit"),
    (r"etc/passwd", "Passwd file", "exploit"),
    (r"etc/shadow", "Shadow file", "exploit"),
    (r"wp-admin", "WP admin", "exploit"),
    (r"wp-login", "WP login", "exploit"),
    (r"/cgi-bin/", "CGI bin", "exploit"),
    (r"/cgi/", "CGI", "exploit"),
    (r"\.php(?:5|6|7|8)?(?:\?|$)", "PHP file", "exploit"),
    (r"\beval\s*\(", "Eval usage", "exploit"),
    (r"\bbase64_decode\b", "Base64 decode", "exploit"),
    (r"\bshell_exec\b", "Shell exec", "exploit"),
    (r"\bsystem\b", "System call", "exploit"),
    (r"\bexec\b", "Exec", "exploit"),
    (r"\bpassthru\b", "Passthru", "exploit"),
    (r"proc/self", "Proc access", "exploit"),
    (r"/etc/hosts", "Hosts file", "exploit"),
    (r"\.aws/credentials", "AWS creds", "sensitive"),
    (r"/id_rsa", "SSH key", "sensitive"),
    (r"/id_dsa", "SSH key", "sensitive"),
    (r"\.pem$", "Private key", "sensitive"),
    (r"\.key$", "Private key", "sensitive"),
    (r"\.htaccess", "HTaccess", "config"),
    (r"\.htpasswd", "HTpasswd", "sensitive"),
    (r"\.gitignore", "Git ignore", "internal"),
    (r"\.DS_Store", "OS file", "internal"),
    (r"phpinfo", "PHPInfo", "exploit"),
    (r"info\.php", "PHPInfo", "exploit"),
    (r"test\.php", "Test PHP", "exploit"),
    (r"\.asax?$", "ASP.NET", "exploit"),
    (r"\.asmx$", "ASMX", "exploit"),
    (r"\.(?:asp|aspx)$", "ASP file", "exploit"),
    (r"\.jsp$", "JSP file", "exploit"),
    (r"\.do$", "Java servlet", "exploit"),
    (r"/admin(?:istrator)?", "Admin path", "exploit"),
    (r"/manage(?:ment)?", "Management", "exploit"),
    (r"/phpmyadmin", "PHPMyAdmin", "exploit"),
    (r"/mysql", "MySQL", "exploit"),
    (r"/database", "Database", "exploit"),
    (r"\.log$", "Log file", "internal"),
    (r"/logs?/", "Logs folder", "internal"),
    (r"\.cache$", "Cache", "internal"),
    (r"/tmp/", "Temp folder", "internal"),
    (r"/temp/", "Temp folder", "internal"),
    (r"\.(?:swp|swo|swn)$", "Swap file", "backup"),
    (r"\.orig$", "Original file", "backup"),
    (r"\.save$", "Saved file", "backup"),
    (r"\.copy$", "Copy file", "backup"),
    (r"\.tmp$", "Temp file", "backup"),
    (r"/\.well-known/", "Well-known", "internal"),
    (r"/\.ssh/", "SSH folder", "sensitive"),
    (r"/wp-json/", "WP REST API", "exploit"),
    (r"/xmlrpc\.php", "XML-RPC", "exploit"),
    (r"/feed/?$", "RSS feed", "internal"),
    (r"/sitemap\.xml", "Sitemap", "internal"),
]

#: The crawlers whose robots directives count.
ROBOT_AGENTS = ["robots", "googlebot", "googlebot-news", "bingbot"]

#: Endings of addresses that are files to a crawl, not pages.
FILE_ENDINGS = ["PDF", "DOC", "DOCX", "XLS", "XLSX", "PPT", "PPTX", "CSV", "ZIP", "RAR", "TXT"]

#: Content types by the ending of an address.
CONTENT_TYPES = {
    "js": "application/javascript", "mjs": "application/javascript", "css": "text/css", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "svg": "image/svg+xml", "ico": "image/x-icon",
    "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "eot": "application/vnd.ms-fontobject", "pdf": "application/pdf", "xml": "application/xml", "json": "application/json", "mp4": "video/mp4", "webm": "video/webm", "mp3": "audio/mpeg", "zip": "application/zip",
}
