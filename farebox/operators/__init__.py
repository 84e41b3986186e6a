"""DataFrame-to-DataFrame operators over canonical purchases.

No operator gathers all rows of a customer, route or day in one task. Windows by
customer run over rows already reduced to one per customer and day (or month), so a
window group is bounded by the calendar however many purchases a customer has.
"""
