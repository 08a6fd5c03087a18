"""Fixed values.

Every table in this module is a fixed value: results must agree on them, so
they are stated as plain text in their natural order.
"""

# fixed values: edge kinds whose meaning is structure
STRUCTURAL_KINDS = [
    "MODULE_IMPORTS_MODULE", "MODULE_EXPORTS_MODULE", "MODULE_DECLARES_COMPONENT",
    "MODULE_DECLARES_ROUTE", "ROUTE_HAS_CHILD", "ROUTE_ACTIVATES_COMPONENT",
    "COMPONENT_CONTAINS_WIDGET", "WIDGET_CONTAINS_WIDGET", "COMPONENT_COMPOSES_COMPONENT",
    "MODULE_PROVIDES_SERVICE", "COMPONENT_PROVIDES_SERVICE",
]

# fixed values: edge kinds that start a workflow
TRIGGER_KINDS = [
    "WIDGET_NAVIGATES_EXTERNAL", "WIDGET_NAVIGATES_ROUTE",
    "WIDGET_SUBMITS_FORM", "WIDGET_TRIGGERS_HANDLER",
]

# fixed values: edge kinds produced by a handler body
EFFECT_KINDS = ["COMPONENT_CALLS_SERVICE", "COMPONENT_NAVIGATES_ROUTE"]

# fixed values: short names of trigger kinds
TRIGGER_ABBREVIATIONS = {
    "WTH": "WIDGET_TRIGGERS_HANDLER", "WSF": "WIDGET_SUBMITS_FORM",
    "WNR": "WIDGET_NAVIGATES_ROUTE", "WNE": "WIDGET_NAVIGATES_EXTERNAL",
}

# fixed values: tag name -> widget kind
TAG_WIDGET_KIND = {
    "button": "Button", "a": "Link", "input": "Input", "select": "Select",
    "option": "Option", "textarea": "Textarea", "form": "Form",
    "mat-menu-item": "MenuItem", "p-menuitem": "MenuItem", "mat-select": "Select",
    "mat-option": "Option", "mat-radio-group": "RadioGroup", "mat-radio-button": "Radio",
    "mat-checkbox": "Checkbox", "mat-slide-toggle": "Checkbox",
}

# fixed values: input type -> widget kind
INPUT_WIDGET_KIND = {
    "button": "Button", "submit": "Button", "reset": "Button",
    "checkbox": "Checkbox", "radio": "Radio",
}

# fixed values: attributes that turn any element into a button
BUTTON_DIRECTIVES = ["mat-button", "mat-raised-button", "mat-icon-button", "matbutton"]

# fixed values: attribute names kept on a widget
KEPT_ATTRIBUTES = [
    "id", "class", "name", "type", "value", "href", "target", "hidden", "readonly",
    "aria-label", "data-testid", "role", "formcontrolname", "placeholder", "title",
]

# fixed values: attributes that become bindings
BINDING_ATTRIBUTES = ["routerlink", "href", "formcontrolname", "formgroupname", "ngmodel"]

# fixed values: elements of plain HTML and of the template language
HTML_ELEMENTS = [
    "a", "abbr", "address", "area", "article", "aside", "audio", "b", "base", "bdi", "bdo", "blockquote", "body", "br",
    "button", "canvas", "caption", "cite", "code", "col", "colgroup", "data", "datalist", "dd", "del", "details", "dfn",
    "dialog", "div", "dl", "dt", "em", "embed", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "header", "hr", "html", "i", "iframe", "img", "input", "ins", "kbd", "label", "legend",
    "li", "link", "main", "map", "mark", "menu", "meta", "meter", "nav", "noscript", "object", "ol", "optgroup",
    "option", "output", "p", "picture", "pre", "progress", "q", "rp", "rt", "ruby", "s", "samp", "script", "section",
    "select", "small", "source", "span", "strong", "style", "sub", "summary", "sup", "table", "tbody", "td", "template",
    "textarea", "tfoot", "th", "thead", "time", "title", "tr", "track", "u", "ul", "var", "video", "wbr",
    "ng-container", "ng-content", "ng-template",
]

# fixed values: elements that never have a closing tag
VOID_ELEMENTS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
]

# fixed values: words that are not references inside a template expression
EXPRESSION_KEYWORDS = [
    "true", "false", "null", "undefined", "typeof", "instanceof",
    "let", "const", "var", "if", "else", "return", "of", "as",
]

# fixed values: bound attributes that rule visibility or enabledness
VISIBILITY_ATTRIBUTES = [
    "hidden", "appShowFor", "showFor", "appHideFor", "hideFor", "appIfPermission", "ifPermission",
]
ENABLEMENT_ATTRIBUTES = [
    "disabled", "ng-disabled", "appHasPermission", "hasPermission", "appDisabledIf",
    "disabledIf", "featureFlag", "appFeatureFlag",
]

# fixed values: event name -> user event
EVENT_TYPES = {
    "click": "click", "input": "input", "change": "change", "submit": "submit",
    "ngsubmit": "submit", "keydown": "keydown", "keyup": "keyup",
    "routerlink": "navigation", "href": "navigation",
}

# fixed values: events of the framework itself
INTERNAL_EVENTS = ["ngmodelchange", "valuechange"]

# fixed values: words that reveal a login check, a role check, a feature switch, an entity state
AUTH_WORDS = [
    "isLoggedIn", "isAuthenticated", "authService", "authGuard",
    "authenticated", "currentUser", "getToken", "isSignedIn",
]
ROLE_WORDS = [
    "hasRole", "hasPermission", "checkRole", "userRole", "requiredRole", "roles", "permissions",
]
FEATURE_WORDS = [
    "isEnabled", "featureEnabled", "featureFlag", "getFlag", "isFeatureActive", "featureFlags",
]
ENTITY_WORDS = {
    "isOrgSelected": "orgSelected", "selectedOrg": "orgSelected",
    "isAccountActive": "accountActive", "accountStatus": "accountActive",
    "tenantId": "tenantSelected",
}

# fixed values: class names that carry layout only
GENERIC_CLASSES = [
    "btn", "btn-default", "btn-primary", "btn-secondary", "btn-success", "btn-danger", "btn-warning", "btn-info",
    "btn-link", "btn-outline-primary", "btn-outline-secondary", "btn-outline-success", "btn-outline-danger",
    "btn-outline-warning", "btn-outline-info", "btn-sm", "btn-lg", "btn-block", "form-control", "form-group",
    "form-horizontal", "form-inline", "form-check", "form-check-input", "form-check-label", "form-label", "form-select",
    "form-text", "form-floating", "input-group", "row", "container", "container-fluid", "container-sm", "container-md",
    "container-lg", "container-xl", "card", "card-body", "card-header", "card-footer", "card-title", "card-text",
    "panel", "panel-body", "panel-heading", "panel-default", "table", "table-responsive", "table-striped",
    "table-bordered", "table-hover", "nav", "nav-item", "nav-link", "navbar", "navbar-nav", "alert", "badge",
    "clearfix", "float-left", "float-right", "text-center", "text-left", "text-right", "d-none", "d-block", "d-flex",
    "d-inline", "d-inline-block", "d-inline-flex", "close", "dropdown-item", "dropdown-toggle", "dropdown-menu",
    "custom-select", "form-control-sm", "btn-dark", "btn-light", "btn-outline-dark", "btn-outline-light", "text-dark",
    "text-muted", "text-light", "text-white", "text-sm", "bg-transparent", "bg-light", "bg-dark", "bg-white",
    "bg-primary", "bg-secondary", "border", "border-top", "border-bottom", "border-left", "border-right", "rounded",
    "rounded-0", "flex-row", "flex-column", "flex-1", "align-self-center", "align-self-start", "align-self-end",
    "justify-content-between", "justify-content-center", "justify-content-start", "justify-content-end", "no-underline",
    "is-editing", "readonly", "modal-title", "modal-header", "modal-body", "modal-footer", "section-title-row",
    "font-serif", "edit-controls", "mat-raised-button", "mat-button", "mat-icon-button", "mat-flat-button",
    "mat-stroked-button", "mat-fab", "mat-mini-fab", "mat-form-field", "mat-input-element", "active", "disabled",
    "hidden", "show", "fade", "collapse", "list-group", "list-group-item",
]

# fixed values: class name prefixes that carry layout only
GENERIC_CLASS_PREFIXES = [
    "col-", "offset-", "order-", "p-", "px-", "py-", "pt-", "pb-", "pl-", "pr-", "m-", "mx-", "my-", "mt-", "mb-",
    "ml-", "mr-", "g-", "gx-", "gy-", "w-", "h-", "align-", "justify-", "bg-", "text-", "rounded-", "border-", "d-sm-",
    "d-md-", "d-lg-", "d-xl-", "font-", "btn-outline-",
]

# fixed values: input type -> value typed into a field of that type
TYPE_VALUES = {
    "password": "Test123!", "tel": "1234567890", "url": "https://example.com",
    "color": "#000000", "date": "2024-01-01", "time": "12:00", "month": "2024-01",
    "week": "2024-W01", "datetime-local": "2024-01-01T12:00", "file": "/tmp/test-file.txt",
}

# fixed values: word inside a field name -> value (first match wins)
NAME_VALUES = [
    (["phone", "fax", "mobile", "telephone"], "1234567890"),
    (["zip", "postal", "postcode"], "12345"),
    (["city"], "TestCity"),
    (["address", "street"], "123 Test St"),
]

# fixed values: whole field name -> value
EXACT_NAME_VALUES = {"country": "US", "state": "CA"}

# fixed values: label aliases used by reference files
WIDGET_KIND_ALIASES = {"Unknown": "OtherInteractive", "Textarea": "TextArea"}
PRECONDITION_ALIASES = {
    "authenticate": "auth-setup", "trigger-dialog": "trigger-dialog-open",
    "trigger-modal": "trigger-dialog-open",
}
INFORMATIONAL_PRECONDITIONS = ["precondition", "ensure-logged-out", "ensure-panel-open"]

# fixed values: time budget of a test in milliseconds
BUDGET_MS = {"auth": 15000, "step": 5000, "navigation": 10000, "buffer": 15000}
