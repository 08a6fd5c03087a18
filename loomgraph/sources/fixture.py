"""How the driver's tables are read as application registries.

The expressions are plain SQL that both engines understand, so the check queries
describe the same input rows. Every application grows with the supplier and customer
tables: twenty suppliers and three hundred customers make one application, so the
number of applications grows with the data and no application grows without bound.
"""

import re

APP_OF_SUPPLIER = "cast((s_suppkey - s_suppkey % 20) / 20 as bigint)"
APP_OF_LINE = "cast((l_suppkey - l_suppkey % 20) / 20 as bigint)"
APP_OF_PAIR = "cast((k - k % 20) / 20 as bigint)"
APP_OF_CUSTOMER = "cast((c_custkey - c_custkey % 300) / 300 as bigint)"

# k supplier, app application, r rank inside the application, n nation, g region
COMPONENT = {
    "subject": "'app' || app",
    "comp_id": "'src/app' || app || '/s' || k || '.ts#S' || k || 'Component'",
    "class_name": "'S' || k || 'Component'",
    "selector": "'app-s' || k || case when k % 5 = 4 then '-dialog' else '' end",
    "file": "'src/app' || app || '/s' || k || '.ts'",
}

# selector or class name used by a component template, by place
USES = [
    ("1", "r > 1 and 2 * r <= 20", "'app-s' || (app * 20 + 2 * r - 1) || case when (app * 20 + 2 * r - 1) % 5 = 4 then '-dialog' else '' end"),
    ("2", "r > 1 and 2 * r + 1 <= 20", "'APP-S' || (app * 20 + 2 * r) || case when (app * 20 + 2 * r) % 5 = 4 then '-dialog' else '' end"),
    ("3", "r % 7 = 0", "'S' || (app * 20 + cast(r / 7 as bigint)) || 'Component'"),
    ("4", "r % 9 = 0", "'app-s' || k || case when k % 5 = 4 then '-dialog' else '' end"),
    ("5", "r % 4 = 0", "'app-x' || k"),
]
USE_CONTEXT = {
    "inside_ng_if": "case when (r + pos) % 3 = 0 then 'isOpen' || (r % 6) end",
    "inside_ng_for": "case when (r + pos) % 8 = 1 then 'rows' || (r % 4) end",
    "inside_template": "case when (r + pos) % 11 = 2 then 1 else 0 end",
}

# j service number
SERVICE = {
    "name": "case when j = 3 then 'RouterService' else 'Svc' || j || 'Service' end",
    "svc_id": "'src/app' || app || '/svc.ts#' || case when j = 3 then 'RouterService' else 'Svc' || j || 'Service' end",
    "file": "'src/app' || app || '/svc.ts'",
    "provided_in": "case when j % 2 = 0 then 'root' else '' end",
}

MODULE_NAME = "case when g = 0 then 'AppModule' else 'R' || g || 'Module' end"
MODULE_ID = "'src/app' || app || '/m' || g || '.ts#' || case when g = 0 then 'AppModule' else 'R' || g || 'Module' end"


def route_path(n: str) -> str:
    return (f"case when {n} = root_n then '/r' || g when {n} = 24 then '/r' || g || '/**' "
            f"else '/r' || g || '/n' || {n} || case when {n} % 3 = 0 then '/:id' else '' end "
            f"|| case when {n} % 4 = 3 then '/:tab' else '' end end")


# n nation, g region, root_n smallest and next_n following nation of the region
ROUTE = {
    "full_path": route_path("n"),
    "path": "case when n = root_n then 'r' || g when n = 24 then '**' else 'n' || n || case when n % 3 = 0 then '/:id' else '' end || case when n % 4 = 3 then '/:tab' else '' end end",
    "redirect_to": f"case when n = 24 then null when g > 0 and n % 8 = 5 then '/missing/n' || n when g = 0 or n % 4 = 1 then {route_path('next_n')} end",
    "guard_1": "case when n % 5 = 2 then 'AuthGuard' when n % 5 = 3 then 'NoAuthGuard' end",
    "guard_2": "case when n % 7 = 4 then 'RoleGuard' end",
    "role": "case when n % 6 = 5 then 'admin' end",
}
PARENT_PATH = "case when n <> root_n then '/r' || g end"

# k supplier, p part, z part size, app application
WIDGET_KIND = ("case z % 10 when 0 then 'Button' when 1 then 'Link' when 2 then 'Form' when 3 then 'Input' "
               "when 4 then 'Select' when 5 then 'Checkbox' when 6 then 'TextArea' "
               "when 7 then case when p % 3 = 0 then 'Option' else 'OtherInteractive' end when 8 then 'Form' else 'Button' end")
WIDGET_TAG = ("case z % 10 when 0 then 'button' when 1 then 'a' when 2 then 'form' when 3 then 'input' "
              "when 4 then 'select' when 5 then 'input' when 6 then 'textarea' "
              "when 7 then case when p % 3 = 0 then 'option' else 'div' end when 8 then 'form' else 'button' end")
WIDGET_ID = f"'src/app' || app || '/s' || k || '.ts#S' || k || 'Component|t' || k || '.html:' || z || ':' || (p % 90) || '|' || {WIDGET_KIND} || '|' || p"


def widget_id_of(pair: str) -> str:
    """Widget id of another part of the same supplier, given as a struct of p and z."""
    return re.sub(r"\b([pz])\b", lambda m: f"{pair}.{m[1]}", WIDGET_ID)


FIELD_KINDS = "('Input', 'Select', 'Checkbox', 'TextArea', 'Button')"

WIDGET_ATTRS = {
    "a_data_testid": "case when p % 25 = 0 then 'test-' || p end",
    "a_id": "case when p % 7 = 0 then 'w' || p end",
    "a_class": "case when p % 41 = 0 then 'd-none box' when p % 6 = 0 then 'btn btn-primary' when p % 3 = 0 then 'hero-card  wide' end",
    "a_name": "case when p % 5 = 1 then 'n' || p end",
    "a_type": "case when kind = 'Checkbox' then 'checkbox' when kind = 'Button' and p % 2 = 0 then 'submit' when kind = 'Input' then case p % 8 when 0 then 'email' when 1 then 'password' when 2 then 'number' when 3 then 'text' when 4 then 'hidden' when 5 then 'date' when 6 then 'tel' else 'file' end end",
    "a_value": "case when kind = 'Option' then 'v' || p end",
    "a_aria_label": "case when p % 22 = 0 then 'Save item' when p % 11 = 0 then 'label.text' end",
    "a_placeholder": "case when p % 13 = 0 then 'Type ' || p end",
    "a_title": "case when p % 17 = 0 then 'Title ' || p end",
    "a_target": "case when p % 4 = 0 then '_blank' end",
    "a_readonly": "case when p % 47 = 0 then 'true' end",
}
WIDGET_UI = {
    "visible_literal": "case when p % 29 = 0 then 0 end",
    "visible_expr": "case when p % 19 = 1 then 'isOpen' || (p % 4) when p % 19 = 2 then 'can:edit' when p % 19 = 3 then '!isLoggedIn' end",
    "enabled_literal": "case when p % 31 = 0 then 0 end",
    "enabled_expr": "case when p % 23 = 2 then 'form.valid' end",
    "required_literal": "case when p % 5 = 0 then 1 end",
    "required_expr": "case when p % 37 = 3 then 'isReq' end",
    "min_length": "case when p % 12 = 1 then 2 + p % 30 end",
    "max_length": "case when p % 6 = 1 then 3 + p % 40 end",
    "min_value": "case when p % 9 = 2 then p % 20 end",
    "max_value": "case when p % 18 in (2, 3) then p % 15 end",
    "pattern": "case p % 16 when 7 then '^[0-9]*$' when 8 then '^[a-zA-Z0-9]+$' when 9 then '^[A-Za-z ]+$' when 10 then '^https?://' when 11 then '.+@.+' end",
    "form_control_name": "case when p % 3 = 1 then case p % 13 when 0 then 'email' when 1 then 'phone' when 2 then 'zipCode' when 3 then 'city' when 4 then 'homeAddress' when 5 then 'country' when 6 then 'state' when 7 then 'password' when 8 then 'username' else 'fc' || (p % 50) end end",
    "ng_model": "case when p % 14 = 5 then 'm.d | date:''yyyy-MM-dd''' end",
    "text": "case when p % 2 = 1 then 'Go ' || (p % 100) when p % 10 = 0 then 'label' end",
    "inside_ng_for": "case when p % 9 = 4 then 'rows' || (p % 3) end",
    "ng_for_item_tag": "case when p % 9 = 4 then case when p % 2 = 0 then 'tr' else 'button' end end",
    "ng_for_ordinal": "case when p % 9 = 4 then p % 4 end",
    "is_template": "case when p % 43 = 0 then 1 else 0 end",
}

# one lineitem is one binding or event; n target nation, g its region
LINE = {
    "seq": "l_orderkey * 8 + l_linenumber",
    "n": "l_orderkey % 25",
    "handler": "'h' || (l_partkey % 40)",
}
LINK_TEXT = ("case (l_orderkey + l_linenumber) % 6 "
             "when 0 then '/r' || (l_orderkey % 5) || case when l_orderkey % 25 >= 5 then '/n' || (l_orderkey % 25) else '' end "
             "when 1 then '''/r' || (l_orderkey % 5) || '/n' || (l_orderkey % 25) || '''' "
             "when 2 then '[''/r' || (l_orderkey % 5) || ''', ''n' || (l_orderkey % 25) || ''', item.id]' "
             "when 3 then '/r' || (l_orderkey % 5) || '/n' || (l_orderkey % 25) || '/{{row.id}}?q=1#top' "
             "when 4 then 'n' || (l_orderkey % 25) || case when l_orderkey % 3 = 0 then '/7' else '' end "
             "else '/nowhere/' || (l_orderkey % 50) end")
LINK_URL = "case when l_orderkey % 3 = 0 then 'https://' when l_orderkey % 3 = 1 then 'http://' else '//' end || 'host' || (l_partkey % 400) || '.example.com/p'"

# a handler body: the lines of its handler with the highest discounts are its calls
IS_CALL = "l_discount >= 0.09"
CALL_EXPR = ("case when l_orderkey % 10 = 9 then 'this.dialog.open' when l_orderkey % 4 = 3 then 'this.router.navigate' "
             "when l_orderkey % 17 = 5 then 'console.log' when l_orderkey % 17 = 6 then 'window.open' "
             "when l_orderkey % 17 = 7 then 'this.h' || (l_partkey % 7) else 'this.svc' || (l_partkey % 10) || 'Service.run' end")
CALL_ARG = (f"case when l_orderkey % 10 = 9 then 'S' || (l_suppkey - l_suppkey % 20 + l_orderkey % 20) || 'Component' "
            f"when l_orderkey % 4 = 3 then {LINK_TEXT} else 'x' || (l_orderkey % 7) end")

# one snippet of template markup per lineitem; an order is one template
SNIPPET = ("case l_partkey % 8 "
           "when 0 then '<form (ngSubmit)=\"save' || (l_partkey % 40) || '()\" class=\"f hidden\"><input type=\"email\" formControlName=\"c' || (l_partkey % 50) || '\" required minlength=\"2\" maxlength=\"' || (l_partkey % 3 * 4) || '\"><textarea placeholder=\" Say \"></textarea></form>' "
           "when 1 then '<button type=\"submit\" [disabled]=\"!ok' || (l_partkey % 7) || ' && form.dirty\" (click)=\"this.save(' || l_partkey || ')\">Go ' || l_partkey || ' now</button>' "
           "when 2 then '<a routerLink=\"/r' || (l_orderkey % 5) || '/n' || (l_orderkey % 25) || '\" id=\"l' || l_partkey || '\">Item ' || l_partkey || '</a>' "
           "when 3 then '<div *ngIf=\"isOpen' || (l_partkey % 5) || '\"><span (click)=\"pick(' || l_partkey || ')\">Pick</span><app-s' || l_suppkey || '></app-s' || l_suppkey || '></div>' "
           "when 4 then '<ul *ngFor=\"let x of xs' || (l_partkey % 3) || '\"><li><button (click)=\"this.del(x)\">Del</button><button class=\"btn\">Two</button></li></ul>' "
           "when 5 then '<select name=\"s' || l_partkey || '\" [showFor]=\"role' || (l_partkey % 3) || '\"><option value=\"v' || l_partkey || '\">V</option></select>' "
           "when 6 then '<input type=\"checkbox\" [hidden]=\"' || case when l_partkey % 3 = 0 then 'true' when l_partkey % 3 = 1 then 'false' else 'x.closed' end || '\" class=\"hide big\"><!-- <a> -->' "
           "else '<ng-template><mat-checkbox (ngModelChange)=\"m()\" title=\"1 > 0\">x</mat-checkbox></ng-template>' end")


# ---- manifests -------------------------------------------------------------------------------

LOGIN_ROUTE = "case when app % 3 <> 2 then '/r2' end"
SKIP_WHERE = "seq % 97 = 0"
FORM_OVERRIDE_WHERE = "l_partkey % 6 = 1"

# folder of a customer's manifest; overdrawn ones were moved
MANIFEST_FOLDER = "'app' || c_custkey || case when c_acctbal < 0 then '-old' else '' end"
# one manifest text per customer; the case arms break one rule each
MANIFEST = (
    "'{\"subjectName\":' || case c_custkey % 11 when 1 then '\"\"' when 2 then '7' else '\"app' || c_custkey || '\"' end "
    "|| case when c_custkey % 13 = 3 then '' else ',\"baseUrl\":\"http://h' || c_custkey || '\"' end "
    "|| ',\"accounts\":' || case when c_custkey % 17 = 4 then '{}' else '[{\"username\":\"' || case when c_custkey % 5 = 0 then '' else c_name end || '\",\"password\":' || case when c_custkey % 7 = 1 then '1' else '\"p\"' end "
    "|| ',\"roles\":' || case when c_custkey % 19 = 5 then '\"admin\"' else '[\"admin\"]' end || ',\"guardSatisfies\":[\"' || case when c_custkey % 2 = 0 then 'AuthGuard' else 'RoleGuard' end || '\"]}]' end "
    "|| case when c_custkey % 23 = 6 then '' else ',\"routeParamValues\":{\"id\":\"' || c_custkey || '\"}' end "
    "|| case when c_custkey % 29 = 7 then ',\"skipWorkflows\":\"all\"' else ',\"skipWorkflows\":[]' end "
    "|| case when c_custkey % 3 = 0 then ',\"executionConfig\":{\"readinessTimeoutMs\":' || (c_custkey % 4 - 1) || ',\"seedCommand\":' || case when c_custkey % 31 = 9 then '5' else '\"seed\"' end || '}' else '' end "
    "|| case when c_custkey % 4 = 1 then ',\"seedRequirements\":{\"authGuards\":[\"AuthGuard\"],\"negativeGuards\":[],\"routeParams\":[\"id\",\"tab\"],\"hasFormWorkflows\":' || case when c_custkey % 8 = 5 then '1' else 'true' end || ',\"seedStatus\":\"' || case c_custkey % 12 when 1 then 'later' when 5 then 'needs-command' else 'none' end || '\"}' else '' end "
    "|| case when c_custkey % 6 = 2 then ',\"authSetup\":{\"loginRoute\":\"/login\",\"usernameField\":\"u\",\"passwordField\":\"' || case when c_custkey % 9 = 5 then '' else 'p' end || '\",\"submitButton\":\"b\"' || case when c_custkey % 10 = 8 then '' else ',\"authSuccessSelector\":\"s\"' end || '}' else '' end "
    "|| case when c_custkey % 41 = 11 then '' else '}' end")

# ---- pages -----------------------------------------------------------------------------------

PAGE_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
PAGE_PATH = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', ''), '/$', ''), '[.]html$', '')"

# statuses of requests, in turn by the length of a step's text
STATUSES = [200, 201, 204, 302, 400, 401, 403, 404, 429, 500]

# guard bodies: passages of documents with code words put in by document number
GUARD_CODE = ("case doc_id % 8 when 0 then 'this.authService.isLoggedIn()' when 1 then 'hasRole([''admin'', ''x-1'', ''no role''])' when 2 then 'featureFlag(''beta ui'')' when 3 then 'tenantId && selectedOrg' "
              "when 4 then 'isAccountActive; roles = [\"owner\"]' when 5 then 'getFlag(\"dark\") && currentUser' else '' end")
