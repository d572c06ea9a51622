"""Operators that prepare training data from source trees and logs. Nothing else imports this."""
