"""Constants shared by the operators. Job parameters, never data."""

# Header synonyms, in the order they are looked up.
HEADER_SYNONYMS = {
    "url": "website",
    "web": "website",
    "sitio web": "website",
    "sitio": "website",
    "pagina web": "website",
    "página web": "website",
    "correo": "email",
    "correo electrónico": "email",
    "correo electronico": "email",
    "e-mail": "email",
    "mail": "email",
    "teléfono": "phone",
    "telefono": "phone",
    "tel": "phone",
    "tel.": "phone",
    "móvil": "phone",
    "movil": "phone",
    "celular": "phone",
    "nombre": "name",
    "nombre empresa": "name",
    "empresa": "name",
    "compañía": "name",
    "compania": "name",
    "dirección": "address",
    "direccion": "address",
    "dir": "address",
    "dir.": "address",
    "ubicación": "address",
    "ubicacion": "address",
    "sector": "sector",
    "categoría": "sector",
    "categoria": "sector",
    "industria": "sector",
    "tipo": "sector",
}

# Column configuration of the cleaning step.
DROP_COLUMNS = [
    "is_spending_on_ads", "can_claim", "owner_name", "owner_profile_link",
    "is_temporarily_closed", "query",
]
RENAME_COLUMNS = {"review_keywords": "seo_keywords", "link": "google_link"}
COLUMN_ORDER = [
    "name", "main_category", "categories", "reviews", "rating", "address",
    "website", "email", "phone", "facebook", "instagram", "linkedin", "x",
    "description", "competitors", "seo_keywords", "workday_timing",
    "closed_on", "featured_image", "google_link", "place_id",
]

SOCIAL_NETWORKS = ["facebook", "instagram", "linkedin", "x"]
CONTACT_COLUMNS = ["email"] + SOCIAL_NETWORKS

# Report sheet names and labels.
DATA_SHEET = "data"
STATS_SHEET = "statistics"
SECTORS_SHEET = "sectors"
ERRORS_SHEET = "errors"
NOTICE_SHEET = "copyright"

# Limits.
SAMPLE_ROWS = 20
PREVIEW_COLUMNS = 5
PREVIEW_ROWS = 20
PREVIEW_CHARS = 40
SOCIAL_URL_LIMIT = 100
RECENT_ERRORS = 100
CACHE_TTL_SECONDS = 3600
MEMORY_LIMIT = 80
CPU_LIMIT = 70
DISK_LIMIT = 90
LOG_MAX_AGE_DAYS = 7
LOG_KEEP_LATEST = 5

# Error classes and messages.
NETWORK_ERROR_CODES = [
    "ERR_CONNECTION_REFUSED", "ERR_NAME_NOT_RESOLVED",
    "ERR_CONNECTION_RESET", "ERR_CONNECTION_ABORTED",
    "ERR_CONNECTION_FAILED", "ERR_INTERNET_DISCONNECTED",
    "ERR_SSL_PROTOCOL_ERROR", "ERR_TIMED_OUT",
]
TRANSIENT_TERMS = [
    "timeout", "connection", "network", "refused",
    "reset", "aborted", "failed", "disconnected",
]
# Class names that are instances of a timeout or a (Python built-in) connection error.
CONNECTION_ERROR_TYPES = [
    "TimeoutException", "ConnectionError", "BrokenPipeError",
    "ConnectionAbortedError", "ConnectionRefusedError", "ConnectionResetError",
]
DOM_ERROR_TYPES = ["NoSuchElementException", "StaleElementReferenceException"]
# Class names of the public WebDriver exception hierarchy.
DRIVER_ERROR_TYPES = [
    "WebDriverException", "InvalidSwitchToTargetException", "NoSuchFrameException",
    "NoSuchWindowException", "NoSuchElementException", "NoSuchAttributeException",
    "NoSuchShadowRootException", "StaleElementReferenceException",
    "InvalidElementStateException", "UnexpectedAlertPresentException",
    "NoAlertPresentException", "ElementNotVisibleException",
    "ElementNotInteractableException", "ElementNotSelectableException",
    "InvalidCookieDomainException", "UnableToSetCookieException",
    "MoveTargetOutOfBoundsException", "UnexpectedTagNameException",
    "InvalidSelectorException", "InvalidArgumentException", "JavascriptException",
    "NoSuchCookieException", "ScreenshotException",
    "ElementClickInterceptedException", "InsecureCertificateException",
    "InvalidCoordinatesException", "InvalidSessionIdException",
    "SessionNotCreatedException", "UnknownMethodException", "NoSuchDriverException",
    "DetachedShadowRootException",
]

# Strings a CSV reader treats as missing (the pandas defaults).
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
