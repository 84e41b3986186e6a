"""Reading purchases and personas, writing results."""
