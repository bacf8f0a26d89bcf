"""Issue and product taxonomy of the training grid."""

# --- Fixed values: names must stay as they are, double and trailing blanks included. -------------

# area -> [(category, sub-category)], 70 in all, in grid order.
ISSUES = {
    "Order": [
        ("Order Delivery Issues", "Delayed delivery"),
        ("Order Delivery Issues", "Package not delivered"),
        ("Order Delivery Issues", "Package shows as delivered but cannot be found"),
        ("Order Delivery Issues", "Delivery to Wrong Address"),
        ("Order Delivery Issues", "Missed delivery"),
        ("Order Delivery Issues", "Order approved but not shipped"),
        ("Order Confirmation and Status", "Tracking/Shipping Updates"),
        ("Order Confirmation and Status", "Confirming order status"),
        ("Invoice and Payment", "Missing invoice"),
        ("Invoice and Payment", "Billing Discrepancies/Overcharging"),
        ("Returns and Refunds", "Damaged Goods/Poor Packaging"),
        ("Returns and Refunds", "Seller's returns policy"),
        ("Product Installation", "Installation after delivery"),
        ("Expedited Delivery", "Faster delivery options"),
    ],
    "Cancellations and returns": [
        ("Return and Exchange", "Returning or exchanging an item"),
        ("Return and Exchange", "Refund Delays/Complications"),
        ("Return and Exchange", "Refund timelines for cancellation or returns"),
        ("Return and Exchange", "Eligibility Disputes"),
        ("Return and Exchange", "Return Shipping/Pickup Issues"),
        ("Return and Exchange", "Package open or tampered on delivery"),
        ("Replacement and Return Process", "Replacement item arrived damaged"),
        ("Replacement and Return Process", "Time frame for receiving a replacement"),
        ("Replacement and Return Process", "Products not eligible for returns"),
        ("Pickup and Shipping", "Pickup process"),
        ("Pickup and Shipping", "Refund not received in bank account"),
        ("Cash on Delivery (CoD) Refunds", "Refund timelines for Cash on Delivery  returns"),
        ("Cash on Delivery (CoD) Refunds", "Refund process for items paid for with Cash on Delivery  "),
        ("Order Cancellation", "Time taken to cancel an order"),
    ],
    "Login and Account": [
        ("Mobile Number and Email Verification", "Issues with receiving the OTP or verification code"),
        ("Mobile Number and Email Verification", "Changing the email ID linked to the account"),
        ("Mobile Number and Email Verification", "Verification requirement for mobile number or email address during login"),
        ("Account Reactivation and Deactivation", "Reactivating an inactive account"),
        ("Account Reactivation and Deactivation", "Deactivating the account"),
        ("Adding and Changing Account Information", "Changing the password for the account"),
        ("Adding and Changing Account Information", "Adding a new delivery address to the account"),
        ("Adding and Changing Account Information", "Using a new email address to log in to the account"),
        ("Login Issues and Error Messages", "Accessing the account when the phone is lost and the password is forgotten"),
        ("Login Issues and Error Messages", "Error message regarding exceeded attempts to enter the correct verification code"),
        ("Login Issues and Error Messages", "Unable to log in after app update"),
    ],
    "Shopping": [
        ("Pricing and Discounts", "Different prices for the same product"),
        ("Pricing and Discounts", "Discount/Promotion Application"),
        ("Pricing and Discounts", "Discounts through exchange offers"),
        ("Pricing and Discounts", "Instant cashback"),
        ("Product Availability and Status", "Ordering 'Out of Stock' or 'Temporarily Unavailable' products"),
        ("Product Availability and Status", "International shipping"),
        ("Account and Shopping", "Account requirement for shopping"),
        ("Account and Shopping", "Hidden charges"),
        ("Loyalty program", "Loyalty points clarifications"),
        ("Loyalty program", "Reward points redemption"),
        ("Pricing and Discounts", "Price increased after adding to cart"),
    ],
    "Shipping": [
        ("Availability of Faster Delivery Options", "Inability to get some items shipped to a location"),
        ("Availability of Faster Delivery Options", "Unavailability of faster delivery options at a specific location"),
        ("Standard Shipping Speeds and Delivery Charges", "Queries regarding delivery charges"),
        ("Standard Shipping Speeds and Delivery Charges", "Understanding the standard shipping speeds"),
        ("Free Delivery Qualification", "Reasons for an order not qualifying for free delivery"),
        ("Standard Shipping Speeds and Delivery Charges", "Delivery charges applied unexpectedly"),
        ("Shipping Options for Returns", "Availability of faster delivery options (e.g., Same Day & In-a-Day) for return requests"),
        ("Contacting Seller's Partnered Courier Service Providers", "How to get in touch with the courier service providers associated with sellers"),
    ],
    "Warranty": [
        ("Warranty Claim Process", "Steps to claim warranty for a product"),
        ("Warranty Claim Process", "Claiming warranty on replacement products"),
        ("Warranty Terms and Changes", "Warranty mismatch between the website and the brand's website"),
        ("Warranty Terms and Changes", "Impact of changes in warranty terms on the product"),
        ("Accessing Warranty Details", "Retrieving warranty details for a product"),
        ("Accessing Warranty Details", "Finding warranty details when the details are not remembered"),
        ("Lost or Missing Warranty Card", "Obtaining warranty without a warranty card"),
        ("Lost or Missing Warranty Card", "Process of claiming warranty without a warranty card"),
        ("Product Registration and Warranty", "Applicability of warranty for products purchased online"),
        ("Product Registration and Warranty", "Need to register the product with the brand for warranty benefits"),
        ("Start Date of Warranty", "Determining the applicable start date for the warranty"),
        ("Extended Warranty", "Process of signing up for an extended warranty for a product"),
    ],
}

# category -> products, 18 in all, in grid order.
PRODUCTS = {
    "Electronics": ["Laptop", "Mobile", "Television", "Tablet", "Headphone", "DSLR Camera"],
    "Appliances": [
        "Refrigerator", "Washing Machine", "Microwave Oven", "Air Conditioner", "Water Purifier",
        "Oven Toaster Grills (OTG)",
    ],
    "Men/Women/Kids": ["T-Shirt", "Jeans", "Shoes", "Toy", "Backpack", "Wrist Watch"],
}


def issue_rows() -> list[tuple[int, str, str, str]]:
    """(position, area, category, sub-category)."""
    flat = [(area, *pair) for area, pairs in ISSUES.items() for pair in pairs]
    return [(i, *row) for i, row in enumerate(flat)]


def product_rows() -> list[tuple[int, str, str]]:
    """(position, category, product)."""
    flat = [(category, name) for category, names in PRODUCTS.items() for name in names]
    return [(i, *row) for i, row in enumerate(flat)]
