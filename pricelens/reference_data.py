"""Fixed reference data: platforms, delivery estimates, pincode prefixes.

The values below must equal the reference system's tables for results to
match, so they are stated plainly, in the reference's natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference system)
# ---------------------------------------------------------------------------

# Delivery minutes by first three pincode digits: (prefix, city, minutes per
# platform in the order of DELIVERY_PLATFORMS).
DELIVERY_PLATFORMS = ["Blinkit", "Zepto", "Swiggy Instamart", "BigBasket", "JioMart", "Amazon Fresh"]
CITY_DELIVERY = [
    ("400", "Mumbai",     [10, 10, 15, 25, 45, 120]),
    ("401", "Mumbai",     [12, 12, 20, 30, 50, 120]),
    ("110", "Delhi",      [10, 10, 15, 25, 40, 120]),
    ("122", "Gurugram",   [10, 10, 18, 30, 45, 120]),
    ("201", "Noida",      [10, 10, 18, 30, 45, 120]),
    ("560", "Bangalore",  [10, 10, 15, 20, 45, 120]),
    ("562", "Bangalore",  [12, 12, 20, 30, 50, 120]),
    ("600", "Chennai",    [12, 12, 18, 30, 50, 120]),
    ("500", "Hyderabad",  [10, 10, 15, 25, 45, 120]),
    ("700", "Kolkata",    [12, 15, 20, 30, 60, 180]),
    ("411", "Pune",       [12, 12, 18, 30, 50, 120]),
    ("380", "Ahmedabad",  [12, 15, 20, 35, 60, 180]),
    ("302", "Jaipur",     [15, 15, 25, 40, 60, 180]),
    ("226", "Lucknow",    [15, 15, 25, 45, 60, 240]),
    ("160", "Chandigarh", [15, 15, 25, 40, 60, 180]),
    ("452", "Indore",     [15, 20, 25, 45, 60, 240]),
]
# Tier-2 / unknown-city minutes by platform; any other platform gets DEFAULT_MINS.
TIER2 = [("Blinkit", 20), ("Zepto", 20), ("Swiggy Instamart", 30),
         ("BigBasket", 60), ("JioMart", 90), ("Amazon Fresh", 240)]
DEFAULT_MINS = 60

# Platforms: (name, active, priority, host, search template, space replacement,
# link-fallback template or None, page-constant delivery minutes).
PLATFORMS = [
    ("Amazon Fresh", True, 1, "https://www.amazon.in",
     "https://www.amazon.in/s?k={}&i=grocery", "+", "https://www.amazon.in/s?k={}&i=grocery", 120),
    ("Blinkit", True, 2, "https://blinkit.com",
     "https://blinkit.com/s/?q={}", "+", "https://blinkit.com/s/?q={}", 10),
    ("BigBasket", True, 3, "https://www.bigbasket.com",
     "https://www.bigbasket.com/ps/?q={}&nc=as", "+", "https://www.bigbasket.com/ps/?q={}", 30),
    ("Zepto", True, 4, "https://www.zepto.com",
     "https://www.zepto.com/search?query={}", "+", "https://www.zepto.com/search?query={}", 10),
    ("Flipkart", False, 5, "https://www.flipkart.com",
     "https://www.flipkart.com/search?q={}&sid=g07", "+", None, 120),
    ("Swiggy Instamart", False, 6, "https://www.swiggy.com",
     "https://www.swiggy.com/instamart/search?query={}", "+", None, 18),
    ("JioMart", False, 7, "https://www.jiomart.com",
     "https://www.jiomart.com/search/{}", "%20", None, 45),
]

# Page settings per platform (fixed values). Extraction returns every offer; the cap is the
# feature of top_n_per_page only. (platform, first-N cap per page, ancestor levels walked, minimum name length,
#  minimum price, minimum price inclusive, names starting with the rupee sign rejected)
PARSER_SETTINGS = [
    ("Amazon Fresh", 35, 0, 4, 1.0, False, False),
    ("Blinkit", 40, 5, 3, 0.0, False, False),
    ("BigBasket", 50, 8, 5, 1.0, True, False),
    ("Zepto", 60, 12, 4, 1.0, True, True),
    ("Flipkart", 60, 10, 5, 1.0, True, False),
    ("Swiggy Instamart", 60, 10, 4, 1.0, True, False),
    ("JioMart", 40, 8, 5, 0.0, False, False),
]

# Location by pincode prefix (lat, lng, place description) used to set the shop
# location before a search; unknown prefixes take the default row.
LOCATIONS = [
    ("560", 12.9716, 77.5946, "Bangalore, Karnataka, India"),
    ("562", 12.9716, 77.5946, "Bangalore, Karnataka, India"),
    ("110", 28.6139, 77.2090, "New Delhi, Delhi, India"),
    ("122", 28.4595, 77.0266, "Gurugram, Haryana, India"),
    ("201", 28.5355, 77.3910, "Noida, Uttar Pradesh, India"),
    ("400", 19.0760, 72.8777, "Mumbai, Maharashtra, India"),
    ("401", 19.0760, 72.8777, "Mumbai, Maharashtra, India"),
    ("411", 18.5204, 73.8567, "Pune, Maharashtra, India"),
    ("500", 17.3850, 78.4867, "Hyderabad, Telangana, India"),
    ("600", 13.0827, 80.2707, "Chennai, Tamil Nadu, India"),
    ("700", 22.5726, 88.3639, "Kolkata, West Bengal, India"),
    ("380", 23.0225, 72.5714, "Ahmedabad, Gujarat, India"),
    ("302", 26.9124, 75.7873, "Jaipur, Rajasthan, India"),
    ("226", 26.8467, 80.9462, "Lucknow, Uttar Pradesh, India"),
    ("160", 30.7333, 76.7794, "Chandigarh, India"),
    ("452", 22.7196, 75.8577, "Indore, Madhya Pradesh, India"),
]
DEFAULT_LOCATION = (12.9716, 77.5946, "Bangalore, Karnataka, India")

# One shop knows fewer prefixes and names the city only (fixed values).
INSTAMART_LOCATIONS = [
    ("560", 12.9716, 77.5946, "Bangalore"),
    ("562", 12.9716, 77.5946, "Bangalore"),
    ("110", 28.6139, 77.2090, "New Delhi"),
    ("122", 28.4595, 77.0266, "Gurugram"),
    ("201", 28.5355, 77.3910, "Noida"),
    ("400", 19.0760, 72.8777, "Mumbai"),
    ("401", 19.0760, 72.8777, "Mumbai"),
    ("411", 18.5204, 73.8567, "Pune"),
    ("500", 17.3850, 78.4867, "Hyderabad"),
    ("600", 13.0827, 80.2707, "Chennai"),
    ("700", 22.5726, 88.3639, "Kolkata"),
    ("380", 23.0225, 72.5714, "Ahmedabad"),
]
INSTAMART_DEFAULT = (12.9716, 77.5946, "Bangalore")

# ---------------------------------------------------------------------------
# Fixture mapping constants (ours): how driver tables become domain tables.
# ---------------------------------------------------------------------------

# Pincode prefix by o_custkey % 20: the 16 known prefixes, then 4 unknown ones.
PINCODE_PREFIXES = [p for p, _, _ in CITY_DELIVERY] + ["403", "751", "781", "834"]
# Platform by l_suppkey % 7 (the seventh, Flipkart, has no delivery row -> 60).
PLATFORM_NAMES = [p[0] for p in PLATFORMS]


def city_delivery_rows():
    """(prefix, city, platform, mins) rows, 16 x 6."""
    return [(prefix, city, plat, mins)
            for prefix, city, minutes in CITY_DELIVERY
            for plat, mins in zip(DELIVERY_PLATFORMS, minutes)]


def city_rows():
    return [(prefix, city) for prefix, city, _ in CITY_DELIVERY]
