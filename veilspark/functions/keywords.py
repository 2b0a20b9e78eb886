"""The words that speak for or against a type, and those of postal addresses. Order is that of reporting."""

CARD_STRONG = ("card number", "card no", "debit card", "credit card", "card holder", "cardholder", "valid thru", "valid through", "bank card", "payment card")
CARD_MEDIUM = ("card", "debit", "credit", "visa", "mastercard", "master card", "rupay", "amex", "payment", "expiry", "expiration", "cvv", "cvc")
IDENTITY_STRONG = ("aadhaar", "aadhar", "uidai", "aadhaar number", "aadhar number", "government id", "identity number", "id number")
IDENTITY_MEDIUM = ("uid", "identity", "national id")
BANK_STRONG = ("account number", "account no", "bank account", "beneficiary", "customer id", "customer number", "transaction id", "upi id")
BANK_MEDIUM = ("account", "bank", "branch", "ifsc", "upi", "transaction", "vpa")
CREDENTIAL_STRONG = ("password", "passcode", "api key", "access key", "private key", "secret key", "authorization", "bearer", "credential")
CREDENTIAL_MEDIUM = ("pin", "otp", "secret", "token", "login", "auth")
WEAK = ("id", "number", "no", "code")

#: type: (strong, medium, weak)
TIERS = {
    "CREDIT_CARD": (CARD_STRONG, CARD_MEDIUM, WEAK),
    "DEBIT_CARD": (CARD_STRONG, CARD_MEDIUM, WEAK),
    "CVV": (("cvv", "cvc", "security code", "card verification"), ("card", "credit", "debit"), ()),
    "CARD_EXPIRY": (("valid thru", "valid through", "expiry", "expiration"), ("card", "credit", "debit"), ()),
    "AADHAAR": (IDENTITY_STRONG, IDENTITY_MEDIUM, WEAK),
    "PAN": (("pan", "permanent account", "pan number"), ("tax", "income tax"), WEAK),
    "SSN": (("ssn", "social security"), ("social",), WEAK),
    "PASSPORT": (("passport", "passport number"), ("travel",), WEAK),
    "UK_NINO": (("national insurance", "nino"), (), WEAK),
    "KR_RRN": (("resident registration", "rrn"), (), WEAK),
    "IBAN": (("iban", *BANK_STRONG), BANK_MEDIUM, WEAK),
    "SWIFT_BIC": (("swift", "bic"), BANK_MEDIUM, WEAK),
    "IFSC": (("ifsc",), BANK_MEDIUM, WEAK),
    "UPI_ID": (("upi id", "vpa"), BANK_MEDIUM, WEAK),
    "BANK_ACCOUNT": (BANK_STRONG, BANK_MEDIUM, WEAK),
    "CRYPTO_WALLET": (("wallet address", "wallet"), ("btc", "eth", "bitcoin", "ethereum", "crypto"), ()),
    "API_KEY": (CREDENTIAL_STRONG, CREDENTIAL_MEDIUM, WEAK),
    "ACCESS_TOKEN": ((*CREDENTIAL_STRONG, "github"), CREDENTIAL_MEDIUM, WEAK),
    "JWT_TOKEN": (CREDENTIAL_STRONG, CREDENTIAL_MEDIUM, ()),
    "PRIVATE_KEY": (CREDENTIAL_STRONG, CREDENTIAL_MEDIUM, ()),
    "PASSWORD": (CREDENTIAL_STRONG, CREDENTIAL_MEDIUM, WEAK),
    "EMAIL": (("email", "e-mail"), ("mail", "contact"), ()),
    "PHONE": (("phone number", "mobile number", "contact number"), ("phone", "mobile", "tel", "call", "contact"), WEAK),
    "IP_ADDRESS": (("ip address", "mac address", "ipv4", "endpoint"), ("server", "host", "network", "ip"), ()),
    "MAC_ADDRESS": (("mac address",), ("mac", "hardware", "network"), ()),
}

NEGATIVE = (
    "order number", "order id", "order no", "invoice number", "invoice no", "invoice", "reference number", "reference no", "ref no", "product code",
    "product id", "sku", "serial number", "serial no", "tracking number", "tracking id", "ticket number", "case number", "receipt", "postal code",
    "zip code", "pincode", "pin code", "otp", "quantity", "price", "amount", "date", "timestamp", "version", "port",
)

#: cue: (points, name in signals, terms)
ADDRESS_CUES = {
    "label": (34, "address label", ("address", "home address", "residential address", "permanent address", "office address", "billing address", "shipping address", "postal address", "correspondence address")),
    "street": (22, "street term", ("street", "st.", "road", "rd.", "lane", "ln.", "avenue", "ave", "boulevard", "blvd", "drive", "marg", "cross", "main road", "highway", "bypass")),
    "unit": (16, "building/unit term", ("apartment", "apartments", "apt", "flat", "building", "block", "tower", "villa", "plot", "house no", "door no", "floor", "suite", "unit", "no.")),
    "locality": (14, "locality term", ("district", "city", "state", "country", "nagar", "colony", "layout", "sector", "phase", "extension", "puram", "pura", "ganj", "vihar", "enclave", "hills", "park", "market", "town", "village", "taluk", "mandal")),
    "state": (20, "", ("tamil nadu", "kerala", "karnataka", "andhra pradesh", "telangana", "maharashtra", "gujarat", "rajasthan", "punjab", "haryana", "delhi", "west bengal", "uttar pradesh", "madhya pradesh", "bihar", "odisha", "assam", "goa", "chandigarh", "jharkhand", "chhattisgarh", "uttarakhand", "himachal pradesh", "jammu", "kashmir")),
}
ADDRESS_POSTAL = ("pincode", "pin code", "postal code", "zip code", "zip", "pin")
ADDRESS_POINTS = {"pincode": 26, "postal": 14, "house": 12, "lines": 8}
