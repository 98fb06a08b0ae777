"""Stored text and patterns that other tools and earlier runs rely on."""

# Addresses used by the public web archive.
ARCHIVE_ROOT = "http://web.archive.org"
AVAILABILITY_QUERY = "http://archive.org/wayback/available?url="
THROTTLE_PAGE = "https://web.archive.org/429.html"

# The target day of a year query (1 July) as it appears in query URLs.
MID_YEAR_SUFFIX = "0701"

# File extensions that are never fetched, and the blocked path.
BLOCKED_EXTENSIONS = (
    "pdf", "png", "jpg", "gif", "docx", "doc", "zip", "xls", "xlsx", "mp3", "mp4",
)
BLOCKED_PATH = "/products/"

# Fixed value: content types read as text ("hmtl" is how stored data was selected).
TEXT_CONTENT_TYPES = "text|hmtl|xml"

# Messages stored in the error table.
NO_TEXT_MESSAGE = "No text found"
NO_TITLE = "No_title"
URL_NOT_FOUND = "Url not found in wayback machine "
URL_NOT_FOUND_QUERY = "\t Url for query : "
ANSWER_UNUSABLE = (
    "ID company not processed because empty or erroneous response from Wayback machine AP."
    " Error for the following url: "
)
ANSWER_QUERY = "; WaybackMachine query : "
ANSWER_BODY = "; Response API Wayback Machine :"
HOMEPAGE_FAILED = (
    "Domain not scraped at all because we do not access to the closest url returned by"
    " WaybackMachine API, "
)
HOMEPAGE_THROTTLED = HOMEPAGE_FAILED + "Error 429 : "
HOMEPAGE_STATUS = HOMEPAGE_FAILED + "status_code: "
PAGE_STATUS = "Error_from_request : status_code : "
PAGE_TRANSPORT = "Error_retry_acces : message : "
LINK_CONTENT_REJECTED = "Error_detected during self.download_page():"
CONTENT_REJECTED = "Error_detected: in access url : "
CONTENT_REJECTED_STATUS = " \t status code: "
TRANSPORT_PREFIX = "Error_detected: "

# Our own wording for a link that did not answer 200, and for a URL that the table of stored responses does not hold.
LINK_STATUS = "Link left out, answered with status "
NOT_STORED = TRANSPORT_PREFIX + "no stored response"

# Fixed value: selects the failures that a page re-run leaves alone.
PERMANENT_STATUS = "status_code : 40[0-9]"

# Which HTML elements bound a paragraph. An opening tag of the
# first group closes an open paragraph; a closing tag of either group closes
# whatever paragraph or heading is still open inside it.
PARAGRAPH_CLOSERS = (
    "address", "blockquote", "center", "dd", "dir", "div", "dl", "dt", "fieldset", "form",
    "hr", "li", "menu", "ol", "pre", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
CONTAINERS = PARAGRAPH_CLOSERS + (
    "article", "aside", "body", "figure", "footer", "header", "html", "main", "nav", "section",
)

# Elements that hold nothing, and those whose own text is not shown.
VOID_ELEMENTS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
TEXT_NOT_SHOWN = ("head", "meta", "script", "style", "title")

# What counts as white space and as a line end in page text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
