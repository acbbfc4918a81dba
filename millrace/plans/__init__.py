"""plans of millrace."""
