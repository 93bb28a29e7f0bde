"""Query understanding, search plans and answers."""
