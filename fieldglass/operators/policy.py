"""Which fields hold identities and of which kind: decided while the plan is made, at no cost per row."""

from __future__ import annotations

import fnmatch
import re
from functools import lru_cache

from fieldglass.functions.scalar import normalised_field

#: Groups of field patterns and the tables that use them.
_GROUPS = {
    "identity": "*accountname,*username,*userprincipalname,*userprincipal,*upn,*email,*emailaddress,*mailaddress,*mailaddresses",
    "email": "*userprincipalname,*userprincipal,*upn,*email,*emailaddress,*mailaddress,*mailaddresses,senderfromaddress,sendermailfromaddress",
    "file": "*filename,*fileinternalname,*fileoriginalname,*folderpath,*filepath,*fullpath,*filedirectory,*workingdirectory,*currentdirectory,*homedirectory,*profilepath,*sharename",
    "domain": "*domain,*domainname,*accountdomain,*dnsname,*dnsdomain,*urldomain,*fqdn",
    "computer": "computer,*devicename,*computername,*machinename,*hostname,*workstationname,*instancevmname",
    "cloud": "*subscriptionid,*resourcegroupname,*resourcegroup,*resourceid",
}
_ALL, _DEVICE, _IDENTITY = "identity file domain computer cloud", "domain computer cloud", "identity domain computer cloud"
_TABLES = {
    _ALL: "deviceprocessevents devicefileevents deviceevents deviceimageloadevents devicenetworkevents deviceregistryevents devicelogonevents alertevidence behaviorentities cloudappevents",
    _DEVICE: "deviceinfo devicenetworkinfo",
    _IDENTITY: "identitylogonevents identityqueryevents identitydirectoryevents aadspndata aadsignineventsbeta azureactivity",
    "email file domain": "emailattachmentinfo",
    "email domain": "emailevents emailpostdeliveryevents urlclickevents",
    "domain": "emailurlinfo",
}
#: Fields with general names that hold identities in these tables alone.
_EXTRA = {
    "aadnoninteractiveusersigninlogs": "alternatesigninname",
    "abapauditlog": "user,host",
    "abapchangedocslog": "user",
    "abaptabledatalog": "user,host",
    "abapuserdetails": "user",
    "alert": "lastmodifiedby,resolvedby",
    "alertevidence": "remoteurl",
    "asimalerteventlogs": "user,processname",
    "asimassetentitylogs": "user",
    "asimfileeventlogs": "actingprocessname",
    "asimprocesseventlogs": "actingprocessname,parentprocessname,targetprocessname",
    "asimregistryeventlogs": "actingprocessname,parentprocessname",
    "awscloudtrail": "clientprovidedhostheader",
    "awsekslogs": "user",
    "awsroute53resolver": "queryname",
    "azureactivity": "resource",
    "azurediagnostics": "resource",
    "azuremetrics": "resource",
    "behavioranalytics": "actorname,actorprincipalname,device",
    "behaviorentities": "remoteurl",
    "cloudprocessevents": "parentprocessname,processname",
    "communicationcomplianceactivity": "actorname",
    "copilotactivity": "actorname",
    "crowdstrikealerts": "assignedtoname",
    "crowdstrikedetections": "assignedtoname",
    "crowdstrikehosts": "lastloginuser",
    "crowdstrikeincidents": "assignedtoname",
    "deviceevents": "remoteurl",
    "devicenetworkevents": "remoteurl",
    "dnsauditevents": "name,zonefile",
    "dynamics365activity": "userid",
    "entraidsigninevents": "alternatesigninname",
    "gcpdns": "queryname",
    "graphnotificationsactivitylogs": "subscriptionidentity",
    "heartbeat": "resource",
    "ilumioinsights": "resourcesubid",
    "linuxauditlog": "user",
    "microsoftpurviewinformationprotection": "userid",
    "officeactivity": "userid",
    "powerappsactivity": "actorname",
    "powerautomateactivity": "actorname",
    "powerbiactivity": "actorname",
    "powerplatformadminactivity": "actorname",
    "powerplatformconnectoractivity": "actorname",
    "powerplatformdlpactivity": "actorname",
    "projectactivity": "actorname,onbehalfofresid",
    "salesforceaudittrail": "createdbyname",
    "securityevent": "account,callerprocessname,clientname,newprocessname,parentprocessname,processname,targetaccount,workstation,userworkstations",
    "sentinelalibabacloudwaflogs": "host,matchedhost",
    "sentinelbehaviorentities": "remoteurl",
    "signinlogs": "alternatesigninname",
}


def default_fields(table: str) -> str:
    """The built-in field patterns of a table, or those for tables that aren't known."""
    name = table.strip().lower()
    groups = next((g for g, tables in _TABLES.items() if name in tables.split()), _ALL)
    return ",".join([*(_GROUPS[g] for g in groups.split()), *([_EXTRA[name]] if name in _EXTRA else [])])


#: Field names whose answers are kept; nested texts may have any number of them.
KNOWN = 4096


class FieldPolicy:
    """Field patterns with * and ?, compared without case and punctuation, with and without a type suffix."""

    def __init__(self, patterns: str):
        self.patterns = []
        self.known: dict[str, bool] = {}
        for p in patterns.split(","):
            clean = "".join(c for c in p.strip().lower() if c.isalnum() or c in "*?")
            if p.strip() and not clean.strip("*?") and clean != "*":
                raise ValueError(f"not a field pattern: {p!r}")
            if clean:
                self.patterns.append(re.compile(fnmatch.translate(clean)))
        if not self.patterns:
            raise ValueError("no field patterns")

    def __contains__(self, field: str) -> bool:
        if (known := self.known.get(field)) is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            names = {normalised_field(field), normalised_field(field, raw=True)}
            self.known[field] = known = any(p.match(n) for p in self.patterns for n in names if n)
        return known


#: Rules from a normalised field name to the kind of its values (fixed values); the first that fits decides.
_KINDS = [
    (r"hash|sha1|sha256|md5", None),
    (r"(filename|fileinternalname|fileoriginalname|processname)$|^zonefile$", "filename"),
    (r"emailaddress|^sender(mail)?fromaddress$|(email|mailaddress(es)?|userprincipal(name)?|upn)$", "email"),
    (r"iptype", None),
    (r"ipaddress|(local|remote|source|destination)ip$", "ip_address"),
    (r"macaddress", "mac_address"),
    (r"sid$|securityidentifier", "sid"),
    (r"phone|mobile", "phone"),
    (r"streetaddress|postaladdress|^address$", "address"),
    (r"resourcegroup(name)?$", "resource_group"),
    (r"(domain|dnsname|fqdn)$|domainname|^(queryname|clientprovidedhostheader)$", "domain"),
    (r"^(computer|host|device|clientname|workstation|userworkstations)$|hostname|computername|devicename|machinename|(workstationname|instancevmname)$", "hostname"),
    (r"^(?=.*displayname).*(device|machine|computer|host)", "hostname"),
    (r"^(?=.*displayname).*(application|organization|company)", "organization"),
    (r"^(?=.*displayname).*(account|user|owner|recipient|sender|person)", "person"),
    (r"fullname|personname|^(actorname|assignedtoname|createdbyname|lastmodifiedby|resolvedby)$", "person"),
    (r"accountname|username|useraccount|loginname|^(user|userid|account|targetaccount|alternatesigninname|lastloginuser|actorprincipalname)$", "username"),
    (r"^resource$", "resource_name"),
    (r"^(subscriptionidentity|resourcesubid|onbehalfofresid)$", "identifier"),
    (r"^(?!.*id$).*(organization|companyname|employer)", "organization"),
    (r"^(eventid|processid|parentprocessid|initiatingprocessid|threadid|productid|vendorid|protocolid)$", None),
    (r"id$", "identifier"),
]
_KINDS = [(re.compile(p), k) for p, k in _KINDS]
_CONTEXT = {"user": "person", "person": "person", "identity": "person", "machine": "hostname", "device": "hostname", "computer": "hostname", "host": "hostname", "organization": "organization", "organisation": "organization", "company": "organization", "group": "organization", "user_group": "organization", "ip": "ip_address", "ipaddress": "ip_address", "address": "ip_address"}
_NAMED_BY = {"label": ("type", "entityType", "nodeLabel"), "name": ("type", "entityType", "nodeLabel"), "nodename": ("type", "entityType", "nodeLabel"), "sourcenodename": ("sourceNodeLabel", "sourceNodeType"), "targetnodename": ("targetNodeLabel", "targetNodeType")}


@lru_cache(KNOWN)
def field_kind(field: str) -> str | None:
    """The kind of entity a field holds by its name, or None."""
    name = normalised_field(field)
    return next((kind for pattern, kind in _KINDS if pattern.search(name)), None) if name else None


def field_kind_in(field: str, row: dict) -> str | None:
    """The same, and for fields named label or name by the type that the row tells."""
    if kind := field_kind(field):
        return kind
    by = {normalised_field(k): v for k, v in row.items()}
    for name in _NAMED_BY.get(normalised_field(field), ()):
        value = by.get(normalised_field(name))
        if isinstance(value, str) and value.strip():
            return _CONTEXT.get(value.strip().lower())
    return None


@lru_cache(KNOWN)
def is_path_field(field: str) -> bool:
    return bool(re.search(r"folderpath|filepath|fullpath|filedirectory|workingdirectory|currentdirectory|homedirectory|profilepath|sharename$", normalised_field(field)))
