"""Dimensions: municipalities, the gazetteer, calendar sources and ticketing venues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ZONE = "America/Toronto"

# Municipalities as (slug, name, short name, level, parent).
MUNICIPALITIES = [
    ("simcoe-county", "County of Simcoe", "Simcoe County", "county", None),
    ("barrie", "City of Barrie", "Barrie", "city", None),
    ("orillia", "City of Orillia", "Orillia", "city", None),
    ("adjala-tosorontio", "Township of Adjala-Tosorontio", "Adjala-Tosorontio", "township", "simcoe-county"),
    ("bradford-west-gwillimbury", "Town of Bradford West Gwillimbury", "BWG", "town", "simcoe-county"),
    ("clearview", "Township of Clearview", "Clearview", "township", "simcoe-county"),
    ("collingwood", "Town of Collingwood", "Collingwood", "town", "simcoe-county"),
    ("essa", "Township of Essa", "Essa", "township", "simcoe-county"),
    ("innisfil", "Town of Innisfil", "Innisfil", "town", "simcoe-county"),
    ("midland", "Town of Midland", "Midland", "town", "simcoe-county"),
    ("new-tecumseth", "Town of New Tecumseth", "New Tecumseth", "town", "simcoe-county"),
    ("oro-medonte", "Township of Oro-Medonte", "Oro-Medonte", "township", "simcoe-county"),
    ("penetanguishene", "Town of Penetanguishene", "Penetanguishene", "town", "simcoe-county"),
    ("ramara", "Township of Ramara", "Ramara", "township", "simcoe-county"),
    ("severn", "Township of Severn", "Severn", "township", "simcoe-county"),
    ("springwater", "Township of Springwater", "Springwater", "township", "simcoe-county"),
    ("tay", "Township of Tay", "Tay", "township", "simcoe-county"),
    ("tiny", "Township of Tiny", "Tiny", "township", "simcoe-county"),
    ("wasaga-beach", "Town of Wasaga Beach", "Wasaga Beach", "town", "simcoe-county"),
    ("cfb-borden", "CFB Borden", "CFB Borden", "base", None),
]

# The names that place a text in each municipality.
GAZETTEER = {
    "simcoe-county": ["Simcoe County", "County of Simcoe"],
    "barrie": ["Barrie", "City of Barrie"],
    "orillia": ["Orillia", "City of Orillia"],
    "adjala-tosorontio": ["Adjala-Tosorontio", "Adjala", "Tosorontio", "Loretto", "Everett", "Lisle", "Rosemont", "Colgan", "Hockley", "Glencairn"],
    "bradford-west-gwillimbury": ["Bradford West Gwillimbury", "Bradford", "Bond Head", "BWG"],
    "clearview": ["Clearview", "Stayner", "Creemore", "Nottawa", "New Lowell", "Duntroon", "Singhampton", "Dunedin", "Avening", "Sunnidale Corners", "Brentwood"],
    "collingwood": ["Collingwood"],
    "essa": ["Essa", "Angus", "Thornton", "Baxter", "Utopia", "Ivy", "Egbert"],
    "innisfil": ["Innisfil", "Alcona", "Stroud", "Lefroy", "Cookstown", "Gilford", "Churchill", "Belle Ewart", "Big Bay Point", "Sandy Cove"],
    "midland": ["Midland"],
    "new-tecumseth": ["New Tecumseth", "Alliston", "Beeton", "Tottenham"],
    "oro-medonte": ["Oro-Medonte", "Oro Medonte", "Horseshoe Valley", "Hawkestone", "Shanty Bay", "Moonstone", "Warminster", "Craighurst", "Guthrie", "Edgar", "Jarratt", "Sugarbush", "Oro Station", "Oro"],
    "penetanguishene": ["Penetanguishene", "Penetang"],
    "ramara": ["Ramara", "Brechin", "Atherley", "Lagoon City", "Longford Mills", "Uptergrove", "Gamebridge", "Sebright", "Udney", "Rama"],
    "severn": ["Severn", "Coldwater", "Washago", "Severn Bridge", "Port Severn", "Marchmont", "Fesserton", "Ardtrea", "Cumberland Beach", "Severn Falls"],
    "springwater": ["Springwater", "Elmvale", "Midhurst", "Minesing", "Hillsdale", "Anten Mills", "Phelpston", "Snow Valley", "Centre Vespra", "Orr Lake"],
    "tay": ["Tay", "Victoria Harbour", "Port McNicoll", "Waubaushene", "Waverley", "Vasey"],
    "tiny": ["Tiny", "Lafontaine", "Perkinsfield", "Wyevale", "Balm Beach", "Woodland Beach", "Wyebridge", "Thunder Beach", "Bluewater Beach"],
    "wasaga-beach": ["Wasaga Beach", "Wasaga"],
    "cfb-borden": ["CFB Borden", "Canadian Forces Base Borden", "Base Borden"],
}

#: Names and their slugs, longest first; names of one length in the order above.
NAMES = sorted(((name, slug) for slug, names in GAZETTEER.items() for name in names), key=lambda x: -len(x[0]))

# The priority of each kind of source (lower wins), and that of an unknown source.
PRIORITY = {"manual": 5, "organization": 8, "municipal": 10, "county": 20, "library": 30, "tourism": 40, "ticketing": 45, "media": 50}
UNKNOWN_PRIORITY = 50

# Sources as (slug, name, kind, platform, municipality, where it is read, options).
_GOVSTACK = [
    ("orillia", "City of Orillia", "municipal", "orillia", "calendar.orillia.ca"),
    ("midland", "Town of Midland", "municipal", "midland", "calendar.midland.ca"),
    ("bradford-west-gwillimbury", "Town of Bradford West Gwillimbury", "municipal", "bradford-west-gwillimbury", "calendar.townofbwg.com"),
    ("springwater", "Township of Springwater", "municipal", "springwater", "calendar.springwater.ca"),
    ("oro-medonte", "Township of Oro-Medonte", "municipal", "oro-medonte", "events.oro-medonte.ca"),
    ("severn", "Township of Severn", "municipal", "severn", "calendar.severn.ca"),
    ("tay", "Township of Tay", "municipal", "tay", "events.tay.ca"),
    ("ramara", "Township of Ramara", "municipal", "ramara", "calendar.ramara.ca"),
    ("penetanguishene", "Town of Penetanguishene", "municipal", "penetanguishene", "calendar.penetanguishene.ca"),
    ("essa", "Township of Essa", "municipal", "essa", "calendar.essatownship.on.ca"),
    ("wasaga-beach", "Town of Wasaga Beach", "municipal", "wasaga-beach", "calendar.wasagabeach.com"),
    ("orillia-library", "Orillia Public Library", "library", "orillia", "events.orilliapubliclibrary.ca"),
]
GOVSTACK_EXCLUDED = ["Public Meeting", "Council Meetings", "Committee Meetings", "Council", "Committees"]
SOURCES = [
    ("manual", "Own listings", "manual", "manual", None, None, {}),
    ("simcoe-county", "County of Simcoe", "county", "eventon", None, "https://simcoe.ca", {}),
    *((s, n, k, "govstack", m, h, {}) for s, n, k, m, h in _GOVSTACK),
    ("barrie", "City of Barrie", "municipal", "drupal-events", "barrie", "https://www.barrie.ca", {"mode": "fullcalendar"}),
    ("innisfil", "Town of Innisfil", "municipal", "drupal-events", "innisfil", "https://www.innisfil.ca", {"mode": "rows"}),
    ("collingwood", "Town of Collingwood", "municipal", "drupal-events", "collingwood", "https://www.collingwood.ca", {"mode": "rows"}),
    ("tiny", "Township of Tiny", "municipal", "drupal-events", "tiny", "https://www.tiny.ca", {"mode": "fullcalendar"}),
    ("clearview", "Township of Clearview", "municipal", "drupal-events", "clearview", "https://www.clearview.ca", {"mode": "fullcalendar"}),
    ("adjala-tosorontio", "Township of Adjala-Tosorontio", "municipal", "eventon", "adjala-tosorontio", "https://adjtos.ca", {}),
    ("new-tecumseth", "Town of New Tecumseth", "municipal", "tribe", "new-tecumseth", "https://www.newtecumseth.ca", {}),
    ("barrie-library", "Barrie Public Library", "library", "communico", "barrie", "barrielibrary.libnet.info", {}),
    ("springwater-library", "Springwater Public Library", "library", "libcal", "springwater", "springwater-ca.libcal.com", {"calendars": "8312,8313,8317"}),
    ("bradford-library", "Bradford West Gwillimbury Public Library", "library", "ics", "bradford-west-gwillimbury", "https://tockify.com/api/feeds/ics/bwgplcc", {}),
    ("clearview-library", "Clearview Public Library", "library", "libcal", "clearview", "clearviewlibrary.libcal.com", {"calendars": "8690"}),
    ("midland-library", "Midland Public Library", "library", "tribe", "midland", "https://midlandlibrary.com", {}),
    ("new-tecumseth-library", "New Tecumseth Public Library", "library", "tribe", "new-tecumseth", "https://ntpl.ca", {}),
    ("barrietoday", "BarrieToday", "media", "spaces", None, "barrie.spaces.ca", {}),
    ("orilliamatters", "OrilliaMatters", "media", "spaces", None, "orillia.spaces.ca", {}),
    ("midlandtoday", "MidlandToday", "media", "spaces", None, "midland.spaces.ca", {}),
    ("collingwoodtoday", "CollingwoodToday", "media", "spaces", None, "collingwood.spaces.ca", {}),
    ("bradfordtoday", "BradfordToday", "media", "spaces", None, "bradford.spaces.ca", {}),
    ("barrie-film-festival", "Barrie Film Festival", "organization", "tribe", "barrie", "https://barriefilmfestival.ca", {}),
    ("orillia-opera-house", "Orillia Opera House", "organization", "tixhub", "orillia", "Orillia-OH", {}),
    ("mat-film-nights", "MAT Film Nights (Mariposa Arts Theatre)", "organization", "mat-film-nights", "orillia", "https://www.mariposaartstheatre.com/filmnights", {"venue": "Galaxy Cinemas Orillia", "address": "865 West Ridge Blvd, Orillia", "admission": "$10 regular admission, $5 student"}),
    ("cfb-borden", "CFB Borden (CFMWS)", "organization", "cfmws", "cfb-borden", "https://cfmws.ca", {"place": "CFB Borden"}),
    ("tourism-barrie", "Tourism Barrie", "tourism", "sitefinity", None, "https://www.tourismbarrie.com", {"detail": "/festivals-events/details"}),
    ("barrie-chamber", "Barrie Chamber of Commerce", "organization", "growthzone", None, "https://business.barriechamber.com", {}),
    ("barrie360", "Barrie 360", "media", "tribe", None, "https://barrie360.com", {}),
    ("simcoe-com", "Simcoe.com", "media", "cityspark", None, "https://www.simcoe.com/events/", {"portal": "Simcoe", "ppid": "9299"}),
    ("eventbrite", "Eventbrite", "ticketing", "eventbrite", None, "-80.45,43.95,-79.1,44.95", {}),
    ("ticketmaster", "Ticketmaster", "ticketing", "ticketmaster", None, "https://www.ticketmaster.ca/", {}),
]
DISABLED = {"manual", "bradfordtoday"}
#: Platforms whose own page about an event is worth reading.
DETAILED = ["govstack", "drupal-events"]

# Ticketing venues as (id, name, municipality).
VENUES = [
    ("KovZpZAFltlA", "Loretto Tavern", "adjala-tosorontio"),
    ("KovZpZAdI7nA", "*Venues Vary By Concert*", "barrie"),
    ("KovZpZAkl7FA", "Army Navy and Air Force Club", "barrie"),
    ("KovZ917AL-i", "Attic Lounge at Flying Monkeys Craft Brewery", "barrie"),
    ("KovZpZAFItdA", "Barrie Central Collegiate", "barrie"),
    ("KovZpZAFI1dA", "Collier Street United Church", "barrie"),
    ("KovZpZAFEkdA", "Fendley Hall", "barrie"),
    ("rZ7HnEZ17fva4", "Ferndale Banquet Hall", "barrie"),
    ("KovZpak2je", "Foundation Night Club", "barrie"),
    ("KovZpZAFIFtA", "Georgian College - Athletic Centre", "barrie"),
    ("KovZpZAJldJA", "Georgian Theatre (formerly known as Gryphon Theatre)", "barrie"),
    ("KovZpZAFltnA", "Heritage Park", "barrie"),
    ("KovZpZAdIdvA", "Hi-Way Pentecostal Church", "barrie"),
    ("KovZ917AL-U", "Homestead Bakery & Cafe", "barrie"),
    ("KovZpZAFtvAA", "Kenzington", "barrie"),
    ("KovZpZA6vIvA", "Liberty North", "barrie"),
    ("KovZ917AL-C", "Meridian Place", "barrie"),
    ("KovZpZAkIt1A", "Roxy Side Room", "barrie"),
    ("KovZpZAFlv7A", "Sadlon Arena", "barrie"),
    ("KovZpZA7dlEA", "Sound Empire", "barrie"),
    ("KovZpZAk6lkA", "SPLASH CANYON WATER PARK", "barrie"),
    ("KovZ917AL-x", "St Andrews Church", "barrie"),
    ("KovZ917AL-b", "Temple Lounge at Donaleigh's Irish Public House", "barrie"),
    ("KovZpZAJdaaA", "The Fox", "barrie"),
    ("KovZpZAFEIAA", "The Mansion Night Club", "barrie"),
    ("KovZpZAkkEJA", "Traffic Lounge", "barrie"),
    ("KovZpZAFtvkA", "W. A. Fisher Auditorium", "barrie"),
    ("KovZpaKw1e", "Great Northern Exhibition Fairgrounds", "clearview"),
    ("rZ7HnEZ17feAg", "Osprey Community Centre", "clearview"),
    ("KovZpZAEdk1A", "All Saints Anglican Church", "collingwood"),
    ("KovZpZAkEJaA", "Collingwood Curling Club", "collingwood"),
    ("KovZ917ARgj", "Creemore Arena", "collingwood"),
    ("KovZpZAkE17A", "Fisher Field", "collingwood"),
    ("KovZpZAFtEkA", "Kaytoo Restaurant & Bar", "collingwood"),
    ("KovZ917ARoe", "Meaford & St. Vincent Community Centre & Arena", "collingwood"),
    ("KovZpaKRne", "Meaford Fairgrounds", "collingwood"),
    ("KovZpZAdIFnA", "Millennium Park", "collingwood"),
    ("KovZpZAdte6A", "Rusty's At Blue", "collingwood"),
    ("KovZpZAdIAvA", "Simcoe Street Theatre", "collingwood"),
    ("KovZpak2Fe", "Angus Glen Golf Club", "essa"),
    ("KovZ917ARiU", "Angus Recreation Centre Gym", "essa"),
    ("rZ7HnEZ17f8AP", "Essa Agriplex", "essa"),
    ("KovZpZAJdnAA", "Georgian Bay Steam Auto Gas and Antique Grounds", "innisfil"),
    ("KovZpZAkklIA", "Innisfil Recreation Complex", "innisfil"),
    ("KovZpZAFneaA", "Alliston Bandshell", "new-tecumseth"),
    ("KovZpZAEAJkA", "Alliston Memorial Arena", "new-tecumseth"),
    ("KovZpZAJFdJA", "Encore", "orillia"),
    ("KovZpaKRGe", "ODAS Park", "orillia"),
    ("KovZpZAkIetA", "Orillia Opera House", "orillia"),
    ("KovZpZAFlvtA", "Burl's Creek Event Grounds", "oro-medonte"),
    ("KovZ917A0ji", "Sunset Barrie - Part of Premier Theatres", "oro-medonte"),
    ("KovZpafKBe", "Sunset Barrie Drive-In Theatre", "oro-medonte"),
    ("KovZ917ARoO", "Penetanguishene Memorial Community Centre Arena", "penetanguishene"),
    ("KovZpZAdEEkA", "Casino Rama Resort", "ramara"),
    ("KovZpZAkkFEA", "J.B. Tudhope Memorial Park", "ramara"),
    ("KovZpZAkAn7A", "Odas Park", "severn"),
    ("KovZpaf73e", "Enaahtig Healing Lodge & Learning Centre", "tay"),
    ("KovZpZAkEa1A", "Dardanella", "wasaga-beach"),
    ("KovZ917AYdh", "Glenwood Drive Pop Up Park", "wasaga-beach"),
    ("KovZ917AYdo", "RecPlex", "wasaga-beach"),
    ("KovZ917AYdp", "Wasaga Sports Park", "wasaga-beach"),
    ("KovZ917AYdG", "Wasaga Stars Arena", "wasaga-beach"),
    ("KovZpafqJe", "WasagaDome", "wasaga-beach"),
]


def municipalities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MUNICIPALITIES, "slug string, name string, short_name string, level string, parent string")


def sources(spark: SparkSession) -> DataFrame:
    rows = [(s, n, k, p, m, w, o, PRIORITY[k], ZONE, s not in DISABLED, p in DETAILED) for s, n, k, p, m, w, o in SOURCES]
    return spark.createDataFrame(rows, "slug string, name string, kind string, platform string, municipality_slug string, origin string, options map<string,string>, priority int, timezone string, enabled boolean, detailed boolean")


def venues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VENUES, "venue_id string, name string, municipality_slug string")
